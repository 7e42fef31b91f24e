"""Operators on documents, against brute force and on odd input."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import bpe, decontaminate, language_id, line_frequency, minmax_dedup, substring_dedup, token_rollup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n string"


def _sentence(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def _odd_rows():
    """Nulls, empty, blank, long, repeated and copied texts, with columns that clash with results."""
    rng = random.Random(7)
    base = _sentence(rng, 120)
    texts = {
        1: None, 2: "", 3: " \t\n ", 4: "one", 5: base, 6: base, 7: base.upper(), 8: base + " tail",
        9: _sentence(rng, 30_000), 10: "ha " * 200, 11: _sentence(rng, 60) + " " + base[:400] + " " + _sentence(rng, 60),
        12: "été 日本語 \U0001f600 \x1c\x85 x", 13: "a b c d e f", 14: "a b c d e f g",
    }
    rows = [(i, t, "en", "src", None, "x", "y") for i, t in texts.items()]
    return [*rows, rows[4], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _words(text):
    return (text or "").encode().split()


# --- language -----------------------------------------------------------------


def test_language_on_held_out_documents(docs):
    got = language_id.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.9 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark, docs, odd, none):
    model = language_id.train_on(docs)
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language_id.identify(none, model).count() == 0
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.where("text IS NULL OR trim(text) = ''").count() == 0
    nothing = language_id.train_on(none)
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}
    # Nothing to tell languages by: what has a letter stays.
    assert {r["doc_id"] for r in language_id.keep_identified(odd, nothing).collect()} == {None, *range(4, 15)}
    assert language_id.query(none).count() == 0


def test_texts_in_no_learned_language_go(docs):
    model = language_id.train(docs)
    rng = random.Random(5)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(100))
             for _ in range(50)]
    clean = [r["text"] for r in docs.collect()]
    assert all(map(model.has_language, clean))
    strict = [t for t in clean if model.has_language(t, 0.3)]
    assert len(strict) > 0.95 * len(clean) and sum(model.has_language(t, 0.3) for t in noise) < 5
    assert not any(map(model.has_language, (None, "", "12 %")))
    alone = language_id.train(docs.where("lang = 'en'"))
    assert alone.least_score() == 1 and all(map(alone.has_language, clean))


def test_language_model_does_not_see_held_out_labels(docs):
    wrong = docs.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    assert "xx" not in {r["lang_pred"] for r in language_id.query(wrong).select("lang_pred").distinct().collect()}


# --- near duplicates -----------------------------------------------------------


def _near_groups(rows, similarity=85):
    """Exact answer: all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    smallest = {}
    for i in ids:
        smallest.setdefault(root(i), i)
    return {i: (len(sets[i]), smallest[root(i)], smallest[root(i)] == i) for i in ids}


def _check_near(df):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minmax_dedup.query(df).collect()}
    assert got == _near_groups([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    return got


def test_near_duplicates_of_documents(docs):
    _check_near(docs)


def test_chain_and_large_group(spark):
    """Copies that drift along a chain, and a group larger than a block whose members meet through others."""
    rng = random.Random(3)
    rows, words = [], [f"w{rng.randrange(9000)}" for _ in range(200)]
    for i in range(12):
        rows.append((100 + i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
    core = [f"v{k}" for k in range(150)]
    for i in range(420):
        copy = list(core)
        for k in rng.sample(range(0, 150, 6), 2):
            copy[k] = f"y{rng.randrange(40)}"
        rows.append((1000 + i, " ".join(copy)))
    got = _check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert len({got[100 + i][1] for i in range(12)}) < 12


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = defaultdict(list)
    for r in minmax_dedup.query(odd).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert sum(map(len, got.values())) == odd.count()
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)]
    assert got[5] == [(116, 5, True)] * 2 and got[6] == [(116, 5, False)] and got[7] == [(116, 5, False)]
    assert got[8] == [(117, 5, False)]
    assert (116, 5, False) in got[None]
    assert minmax_dedup.query(none).count() == 0
    kept = minmax_dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[5] == 1 and not ids.keys() & {6, 7, 8} and ids[1] == ids[2] == ids[3] == 1
    assert minmax_dedup.one_of_each(none).count() == 0


def test_links_at_another_similarity(spark):
    rng = random.Random(13)
    rows = []
    for group in range(40):
        base = _sentence(rng, 200).split()
        rows.append((10 * group, " ".join(base)))
        for i in range(1, 5):
            copy = list(base)
            for k in range(rng.randrange(10)):
                copy[20 * k + rng.randrange(15)] = "changed"
            rows.append((10 * group + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for similarity in (80, 90):
        got = {r["doc_id"]: r["component_id"] for r in minmax_dedup.near_duplicates(df, similarity=similarity).collect()}
        assert got == {i: c for i, (_, c, _) in _near_groups(rows, similarity).items()}


def test_keys_tell_nulls_apart(spark):
    rows = [("x y", None), (None, "x y"), ("x y", "x y"), (None, None)]
    got = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len({r["_rk"] for r in got}) == 4
    assert sorted(r["n_shingles"] for r in got) == [0, 0, 1, 1]


def test_one_of_each_group_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(400)]
    one, near, other = " ".join(words), " ".join([*words[:399], "x"]), " ".join(reversed(words))
    for rows, want in [
        ([(1, one), (1, other)], {(1, one), (1, other)}), ([(1, one), (1, near), (1, other), (2, near)], None),
        ([(None, one), (None, near), (None, other)], None), ([(2, one), (1, near), (None, one)], {(1, near)}),
    ]:
        got = [tuple(r) for r in minmax_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        if want is not None:
            assert len(got) == len(want) and set(got) == want
        else:  # one of the near copies, whichever, and the other text
            assert len(got) == 2 and sum(t == other for _, t in got) == 1


def test_min_max_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 1000, np.uint64)
    a, b = values[:900], values[100:]
    pairs = [(minmax_dedup.min_max(np.unique(a * np.uint64(m))), minmax_dedup.min_max(np.unique(b * np.uint64(m))))
             for m in range(1, 41, 2)]
    share = np.mean([(x == y).mean() for x, y in pairs])
    assert abs(share - 0.8) < 0.03


# --- repeated windows ----------------------------------------------------------


def _removed(rows, width):
    texts = [_words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = Counter()
    for (key, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeated_windows(docs, odd, none):
    for df in (docs, odd):
        want = _removed([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], 35)
        assert Counter(tuple(r) for r in substring_dedup.query(df.select("doc_id", "text")).collect()) == want
    assert substring_dedup.query(none).count() == 0


def test_windows_of_periodic_and_shared_text(spark):
    rng = random.Random(11)
    words = "a b c d".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(100, "a " * 30), (101, "a b " * 12), (102, "a"), (103, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = substring_dedup.remove_repeated(df, width=6)
    got = Counter((r["doc_id"], r["_n_words"], r["_n_removed"], hashlib.sha256(r["_kept"].encode()).hexdigest())
                  for r in done.collect())
    assert got == _removed(rows, 6)
    for r in done.collect():
        assert sum(b - a for a, b in r["_intervals"]) == r["_n_removed"]
        assert all(x[1] < y[0] for x, y in zip(r["_intervals"], r["_intervals"][1:]))


def test_texts_that_lose_nothing_stay_as_they_are(odd):
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(odd).collect()}
    assert kept[2] == "" and kept[3] == " \t\n " and kept[1] is None and 5 not in kept and 10 not in kept
    assert substring_dedup.without_repeats(odd).columns == odd.columns


# --- benchmark -----------------------------------------------------------------


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 120)))
        assert decontaminate.Pattern(item).best(text)[0] == _distance(item, text)


def test_items_with_edits_are_found(spark, odd, none):
    rng = random.Random(2)
    items = [(i, _sentence(rng, 25)) for i in range(6)] + [(6, "Short one!"), (7, None), (8, ""), (9, "...")]
    rows, want = [], set()
    for i, text in items[:6]:
        for n in range(4):
            s = list(text)
            for _ in range(n * 3):
                p = rng.randrange(len(s))
                s[p : p + 1] = rng.choice([["q"], [], ["z", s[p]]])
            body = _sentence(rng, 40) + "\n" + "".join(s).upper() + ", " + _sentence(rng, 40)
            rows.append((10 * i + n, body))
            norm = decontaminate.normalised(text)
            if _distance(norm, decontaminate.normalised(body)) <= decontaminate.budget(len(norm)):
                want.add((10 * i + n, i))
    rows += [(90, "a short  ONE: indeed"), (91, "shortone"), (92, None), (93, ""), (90, "a short  ONE: indeed")]
    want.add((90, 6))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (10**6, 300):
        got = decontaminate.find_items(df, table, block_bytes=block_bytes).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) + 1
        clean = decontaminate.without_items(df, table, block_bytes=block_bytes)
        assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    text_of = {i: decontaminate.normalised(t) for i, t in rows}
    for r in got:
        part, item = text_of[r["doc_id"]][r["first"] : r["end"]], decontaminate.normalised(dict(items)[r["item_id"]])
        assert r["distance"] == 0 and part == item or abs(len(part) - len(item)) <= r["distance"]
    nothing = table.where("item_id IS NULL")
    assert decontaminate.find_items(odd, nothing).count() == 0
    assert decontaminate.without_items(odd, nothing).count() == odd.count()
    assert decontaminate.find_items(none, table).count() == 0


# --- tokens --------------------------------------------------------------------


def test_encoding_equals_the_library(spark, docs, odd, none):
    library = bpe._library(bpe.load())
    special = spark.createDataFrame(
        [(50, "<|endoftext|>hi <|endoftext|>  there\n\n x"), (51, " it's we'LL don't\t\r\n 'S <|endof"),
         (52, "՘֋ \U0001e900 ١٢ Ⅰ ﻿​")], "doc_id long, text string")
    for df in (docs, odd, special):
        rows = df.select("doc_id", "text").collect()
        want = Counter()
        for r in rows:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                 hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.query(df).collect()) == want
    assert bpe.query(none).count() == 0


def test_small_blocks_and_parts_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20_000)
    back = bpe.decode(bpe.encode(docs, parts=3))
    assert back.join(docs, "doc_id").where("decoded <> text").count() == 0 and back.count() == docs.count()


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))


# --- lines ---------------------------------------------------------------------


def test_frequent_lines(spark, none):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        body = "\n".join(_sentence(rng, 12) for _ in range(8))
        rows.append((i, f"Shared  LINE here\n{body}" if i < 30 else body, "a" if i % 2 == 0 else None))
    rows.append((99, "\n".join(["shared line here"] * 30), "a"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_frequency.judged(df, min_docs=10, share=0.1).collect()}
    assert all(got[i]["n_words_removed"] == (3 if i < 30 else 0) and got[i]["kept"] for i in range(60))
    assert got[99]["base_failed"] and not got[99]["kept"] and got[99]["n_dup_lines"] == 29
    kept = line_frequency.without_frequent_lines(df, min_docs=10, share=0.1)
    assert kept.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[0] == rows[0][1].split("\n", 1)[1] and texts[59] == rows[59][1] and 99 not in texts
    assert line_frequency.query(none).count() == 0


def test_line_measures_of_odd_rows(odd):
    got = defaultdict(list)
    for r in line_frequency.query(odd).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == odd.count()
    assert [got[1][0][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [0] * 5
    assert got[1][0]["base_failed"] and not got[1][0]["kept"]
    assert got[10][0]["n_repeat_words"] == 200 and got[10][0]["base_failed"]
    assert got[5][0]["kept"] and len(got[5]) == 2 and len(got[None]) == 2


def test_depleted_documents_go(spark):
    common = "\n".join(f"common line {k} of everybody here" for k in range(10))
    rows = [(i, common + "\n" + " ".join(f"d{i}x{k}" for k in range(20 if i < 5 else 100))) for i in range(30)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in line_frequency.query(df).collect()}
    assert got == {i: i >= 5 for i in range(30)}


# --- totals --------------------------------------------------------------------


def test_totals_follow_signed_changes(spark, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer string, change string, n_tokens long, seq int"
    rollup = token_rollup.Rollup(spark, str(tmp_path / "tokens"))
    assert rollup.totals().count() == 0

    def commit(number, *rows):
        return rollup.commit(number, spark.createDataFrame(list(rows), schema))

    def totals():
        return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}

    first = [(1, "a", "en", "t1", "insert", 10, 0), (2, "a", "en", "t1", "insert", 5, 0), (2, "a", "en", "t2", "insert", 7, 0),
             (None, None, None, "t1", "insert", None, 0), (3, "b", "de", "t1", "insert", 1, 0),
             (3, "b", "de", "t1", "insert", 4, 1)]
    assert commit(1, *first) and not commit(1, *first)
    want = {("a", "en", "t1"): (2, 15), ("a", "en", "t2"): (1, 7), (None, None, "t1"): (1, 0), ("b", "de", "t1"): (1, 4)}
    assert totals() == want
    changes = [(1, None, None, "t1", "delete", 0, 0), (2, "c", "en", "t1", "revise", 6, 0), (9, "a", "en", "t1", "revise", 5, 0),
               (9, "a", "en", "t1", "delete", 5, 0), (None, None, None, "t1", "insert", 3, 0)]
    assert commit(2, *changes) and not commit(2, *changes)
    want = {("c", "en", "t1"): (1, 6), ("a", "en", "t2"): (1, 7), (None, None, "t1"): (1, 3), ("b", "de", "t1"): (1, 4)}
    assert totals() == want
    assert commit(3) and totals() == want


def test_rows_without_an_id_or_with_a_repeated_one_all_count(spark):
    rows = [(None, "a b 1", "s", "en"), (None, "a b 1", "s", "en"), (None, "c", "s", None), (1, "a 1", "s", "en"), (1, "b", "t", "en"),
            (2, "x y", "s", "en"), (2, "x y", "s", "en"), (3, "q 7", "s", "en"), (3, "q 7", "s", "en"), (3, None, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    labels = spark.createDataFrame(
        [(2, 1, 1), (2, 1, 1), (3, 0, 0), (None, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in token_rollup.query(docs, labels).collect()}
    assert got == {
        ("s", "en", "words-1", 6, 3 + 3 + 2 + 1 + 1 + 0), ("s", "en", "marks-1", 6, 3 + 3 + 2 + 2 + 2 + 0),
        ("s", None, "words-1", 1, 1), ("s", None, "marks-1", 1, 1), ("t", "en", "words-1", 1, 1), ("t", "en", "marks-1", 1, 1)}


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    place = str(tmp_path / "tokens")
    schema = "doc_id long, source string, lang string, tokenizer string, change string, n_tokens long, seq int"
    rows = spark.createDataFrame([(1, "a", "en", "t", "insert", 2, 0)], schema)
    rollup = token_rollup.Rollup(spark, place)
    # Only the ledger of batch 1 came through.
    spark.createDataFrame([(1, "a", "en", "t", 1, 99)], "doc_id long, source string, lang string, tokenizer string, "
                          "n_docs long, n_tokens long").write.parquet(f"{place}/ledger/batch=1")
    assert not rollup.committed(1) and rollup.commit(1, rows)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 2)]


def test_lines_are_removed_and_documents_rejected_by_the_given_limits(spark):
    """At hosts of 10, 50 and 500 documents, with the limits of the query."""
    rows, at = [], 0
    for host, size in (("a", 10), ("b", 50), ("c", 500)):
        for i in range(size):
            own = " ".join(f"{host}{i}x{k}" for k in range(60))
            lines = (["menu of every page here"] if i % 8 == 0 else []) + ([f"long passage {k} that some share" for k in range(12)] if i % 14 == 0 else [])
            rows.append((at, "\n".join([own, *lines]), host, "k", 1))
            at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _rk string, _removed int").repartition(4)
    got = {r["doc_id"]: r for r in line_frequency.query(df).collect()}
    kept = {r["doc_id"]: r for r in line_frequency.without_frequent_lines(df).collect()}
    for doc_id, text, host, _, _ in rows:
        i = doc_id - {"a": 0, "b": 10, "c": 60}[host]
        lost = 0 if host == "a" else (5 if i % 8 == 0 else 0) + (72 if host == "c" and i % 14 == 0 else 0)
        assert got[doc_id]["n_words_removed"] == lost and not got[doc_id]["base_failed"]
        assert got[doc_id]["kept"] == (lost <= 0.5 * len(text.split())) == (doc_id in kept)
        assert doc_id not in kept or (kept[doc_id]["_rk"], kept[doc_id]["_removed"]) == ("k", 1)
    assert 0 < len(rows) - len(kept) < 60


def test_a_batch_with_all_its_files_but_no_commit_does_not_count(spark, tmp_path):
    """As it is when the driver is lost after the last file and before the commit."""
    place, schema = str(tmp_path / "tokens"), "doc_id long, source string, lang string, tokenizer string, change string, n_tokens long, seq int"

    def rows(*changes):
        return spark.createDataFrame([(1, "a", "en", "t", change, n, 0) for change, n in changes], schema)

    rollup = token_rollup.Rollup(spark, place)
    assert rollup.commit(1, rows(("insert", 5)))
    spark.createDataFrame([(1, "a", "en", "t", 1, 100)], "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long").write.parquet(f"{place}/ledger/batch=2")
    spark.createDataFrame([("a", "en", "t", 1, 100)], "source string, lang string, tokenizer string, n_docs long, n_tokens long").write.parquet(f"{place}/rollup/batch=2")
    assert not rollup.committed(2) and [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 5)]
    assert rollup.commit(2, rows(("revise", 7))) and not rollup.commit(2, rows(("revise", 9)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 7)]
