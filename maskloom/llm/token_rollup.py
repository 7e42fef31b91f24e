"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch of changes (insert, delete, revise) becomes signed rows: a delete takes off what the
document last counted, a revision takes that off and adds the new count.  The signed rows
go to a ledger, their sums by group to a rollup, each in the folder of the batch, and the
totals are the sum of all rollups.  A batch is committed by a small file that one rename puts in
place when both are written: a batch that is committed is not applied again, one that broke
off, whatever it has written, is written anew over its remains, and readers see committed
batches only.  A commit reads the ledger, not the corpus.

Results for odd input: a null count is 0; null ids, sources, languages and tokenizers are
values of their own; of several changes to a document and tokenizer in one batch the last by
``seq`` counts (of ties a delete, then the larger count); an insert of what is there revises
it; a delete or revision of what is not there does nothing; an empty batch commits nothing
but its number.  The query gives every row of the corpus a key of its own, so rows without
an id and rows that repeat one all count; labels meet all rows of their id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.files import Folder
from maskloom.session import cut_lineage, shared_dir

INSERT, DELETE, REVISE = "insert", "delete", "revise"
GROUP = ["source", "lang", "tokenizer"]
_WORD = r"[^\x20\x09-\x0D]+"
_MARK = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
_LETTERED = r"[^\x20\x09-\x0D]*[A-Za-z][^\x20\x09-\x0D]*"
#: Tokenizer versions that are counted, with their patterns.
TOKENIZERS = {"words-1": _WORD, "marks-1": _MARK}


def tokens(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


class Rollup:
    """A ledger and its totals in a folder that all executors see."""

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.place, self._commits = spark, place, Folder(spark, f"{place}/commits")

    def _done(self) -> list[int]:
        """Numbers of the committed batches."""
        return sorted(int(n) for n in self._commits.names() if not n.startswith("."))

    def _read(self, what: str) -> DataFrame | None:
        """The rows of all committed batches."""
        done = self._done()
        if not done:
            return None
        return self.spark.read.parquet(f"{self.place}/{what}").where(F.col("batch").isin(done))

    def committed(self, batch: int) -> bool:
        return batch in self._done()

    def _counted(self, key_kind: str) -> DataFrame:
        """What each document counts now: ``doc_id`` and group with ``n_tokens``."""
        ledger = self._read("ledger")
        if ledger is None:
            return self.spark.createDataFrame(
                [], f"doc_id {key_kind}, source string, lang string, tokenizer string, n_tokens long")
        return (
            ledger.groupBy("doc_id", *GROUP)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs > 0").drop("n_docs")
        )

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, source, lang, tokenizer, change, n_tokens, seq) once; False if it was done before."""
        if self.committed(batch):
            return False
        last = Window.partitionBy("doc_id", "tokenizer").orderBy(
            F.col("seq").desc(), (F.col("change") == DELETE).desc(), F.col("n_tokens").desc(), *GROUP[:2])
        new = (
            changes.select("doc_id", *GROUP, "change", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "seq")
            .withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "seq")
        )
        old = self._counted(changes.schema["doc_id"].dataType.simpleString()).select(
            F.col("doc_id").alias("_id"), F.col("tokenizer").alias("_tokenizer"),
            F.struct("source", "lang", "tokenizer", "n_tokens").alias("old"))
        met = new.join(old, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("tokenizer").eqNullSafe(F.col("_tokenizer")), "left")
        # What a change takes off and what it adds come from one pass over it.
        off = F.when(F.col("old").isNotNull(), F.struct(
            *[F.col(f"old.{c}").alias(c) for c in GROUP], F.lit(-1).cast("long").alias("n_docs"),
            (-F.col("old.n_tokens")).alias("n_tokens")))
        on = F.when((F.col("change") == INSERT) | ((F.col("change") == REVISE) & F.col("old").isNotNull()), F.struct(
            *GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens"))
        moved = met.select("doc_id", F.explode(F.array_compact(F.array(off, on))).alias("c")).select("doc_id", "c.*")
        moved.write.mode("overwrite").parquet(f"{self.place}/ledger/batch={batch}")
        signed = self.spark.read.parquet(f"{self.place}/ledger/batch={batch}")
        (signed.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
         .write.mode("overwrite").parquet(f"{self.place}/rollup/batch={batch}"))
        return self._commits.publish(str(batch), "")

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``n_docs``, ``n_tokens`` of all committed batches."""
        rollup = self._read("rollup")
        if rollup is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return (
            rollup.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs <> 0 OR n_tokens <> 0")
        )


def counted_rows(docs: DataFrame) -> DataFrame:
    """``id``, ``doc_id``, ``source``, ``lang`` and counts of every row; ``doc_id`` is made of id, hash and occurrence."""
    counts = {name: tokens(F.col("text"), pattern) for name, pattern in (TOKENIZERS | {"lettered": _LETTERED}).items()}
    # Equal rows are counted on the map side and numbered apart, so many of them are no long task.
    return (
        docs.select(F.col("doc_id").alias("id"), "source", "lang", F.xxhash64("source", "lang", "text").alias("h"),
                    *[c.alias(name) for name, c in counts.items()])
        .groupBy("id", "source", "lang", "h", *[f"`{name}`" for name in counts]).agg(F.count("*").alias("n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        .select("id", F.struct(F.col("id"), "h", "copy").alias("doc_id"), "source", "lang", *[f"`{name}`" for name in counts])
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after all documents came in, toxic ones went and those of low quality were counted anew.

    The first and the last batch are committed twice, which changes nothing.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    # Texts are read once and counted before any join, so that none is shuffled.
    rows = cut_lineage(counted_rows(docs))

    def changes(of: DataFrame, change: str, counts: dict[str, str]) -> DataFrame:
        each = F.explode(F.array(*[
            F.struct(F.lit(name).alias("tokenizer"), F.col(f"`{count}`").alias("n_tokens"))
            for name, count in counts.items()])).alias("c")
        return of.select("doc_id", "source", "lang", each).select(
            "doc_id", "source", "lang", "c.tokenizer", F.lit(change).alias("change"), "c.n_tokens", F.lit(0).alias("seq"))

    def of_labels(which: str) -> DataFrame:
        return rows.join(labels.where(which).select(F.col("doc_id").alias("id")).distinct(), "id")

    own = {name: name for name in TOKENIZERS}
    first = changes(rows, INSERT, own)
    rollup.commit(1, first)
    rollup.commit(1, first)
    rollup.commit(2, changes(of_labels("toxic = 1"), DELETE, own))
    revised = changes(of_labels("quality = 0"), REVISE, {"words-1": "lettered"})
    rollup.commit(3, revised)
    rollup.commit(3, revised)
    return rollup.totals()


ORACLE = rf"""
WITH said AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
kept AS (
  SELECT source, lang, coalesce(text, '') AS t, coalesce(quality, 1) AS quality
  FROM documents LEFT JOIN said USING (doc_id) WHERE coalesce(toxic, 0) <> 1),
counted AS (
  SELECT source, lang, 'words-1' AS tokenizer,
         len(regexp_extract_all(t, CASE WHEN quality = 0 THEN '{_LETTERED}' ELSE '{_WORD}' END)) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'marks-1', len(regexp_extract_all(t, '{_MARK}')) FROM kept)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM counted GROUP BY ALL
"""
