"""License scans, filter audits and vector codes, against brute force and on odd input."""

import itertools
import random
import re

import numpy as np
import pytest

from maskloom.llm import filter_audit, license_scan, vector_codes

DOCS = "doc_id long, text string, lang string, found string, n string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _texts():
    """Odd texts, copies of them, and lines of licenses inside noise."""
    rng = random.Random(11)

    def noise(n):
        return " ".join(rng.choice(["the", "of", "license", "under", "w1", "w2", "Été", "version", "CC", "by"]) for _ in range(n))

    lines = [t for t, _ in license_scan.PHRASES + license_scan.NOTICES]
    texts = [None, "", " \t\n", "CC", "cc-by", "cc by cc by cc by", "The MIT\nLicense", "a" * 50, "MIT licenses", "x MIT License"]
    texts += [f"{noise(rng.randrange(60))} {line.title()}. {noise(rng.randrange(60))}" for line in lines]
    texts += [" ".join(w for w in line.split() if rng.random() > 0.08) for line in lines for _ in range(3)]
    texts += [noise(400), noise(250) + " Apache License " * 30, " ".join(f"v{i}" for i in range(20_000)) + " mit license", "VERY BIG | $", "é É " * 150]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    texts = _texts()
    rows = [(i, t, rng, "x", "y", "z") for i, (t, rng) in enumerate(zip(texts, itertools.cycle(["en", "fr", None, ""])))]
    rows += [(100 + i, t, "de", None, None, None) for i, t in enumerate(texts[::3])]
    rows += [rows[4], rows[12], (None, texts[14], None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- license scans ------------------------------------------------------------


def _scan(text, threshold=license_scan.THRESHOLD):
    """Every block of every template, counted."""
    words = PLAIN.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    base = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, score = {label for _, label in base}, 1.0 if base else 0.0
    for line, label in license_scan.NOTICES:
        template = license_scan.Template(line, label)
        own, half = set(line.split()), template.half
        for b in range(len(words) // half + 1):
            share = len(own & set(words[b * half : (b + 2) * half])) / len(own)
            if share >= threshold - 1e-12:
                labels.add(label)
                score = max(score, share)
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None),
            ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), score)


def test_licenses_equal_brute_force(odd):
    got = sorted((tuple(r) for r in license_scan.query(odd).collect()), key=str)
    want = sorted(((r["doc_id"], *_scan(r["text"])) for r in odd.collect()), key=str)
    assert got == want
    assert any(g[5] != g[6] for g in got) and any(0.9 <= g[7] < 1 for g in got)


def test_licenses_in_several_groups(odd):
    """Templates beyond the bound are met in further passes; together they find the same."""
    def found(df):
        return sorted(str((r["doc_id"], f)) for r in df.collect() for f in r["found"])

    assert found(license_scan.scanned(odd, group_chars=200)) == found(license_scan.scanned(odd))


def test_passages_as_long_as_half_a_block_are_found(spark):
    template = license_scan.Template("alpha beta gamma delta epsilon zeta eta theta", "own")
    texts = ["x " * shift + template.text + " y" * 40 for shift in range(70)]
    got = license_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), [template])
    assert all(any(f["containment"] == 1.0 for f in r["found"]) for r in got.collect())


# --- filter audit -------------------------------------------------------------


def _fails(rows):
    out = []
    for doc_id, text, part in rows:
        words, text = WORD.findall(text or ""), text or ""
        copy = any(t == text and i is not None and doc_id is not None and i < doc_id for i, t in ((i, t or "") for i, t, _ in rows))
        out.append((part or "", "".join(c for c, f in zip("ABCDE", [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            any(c in "#$%&*|" for c in text), copy]) if f), doc_id))
    return out


def _audit(rows, good, toxic):
    fails, out = _fails(rows), []
    for part in sorted({p for p, _, _ in fails}):
        own = [(f, i) for p, f, i in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                shapley[letter] += len(gone)
                lines.append([part, "".join(order), step, len(left), len(gone), sum(letter in f for f, _ in own) - len(gone),
                              sum(f == letter for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), letter])
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return out


def test_audit_equals_filters_run_one_after_the_other(spark, odd, none):
    labels = [(i, [1, 0, None][i % 3], [None, 1][i % 2]) for i in range(0, 120)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    got = sorted(tuple(r) for r in filter_audit.query(odd, marks).collect())
    assert got == sorted(_audit([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], good, toxic))
    assert filter_audit.query(none, marks).count() == 0
    assert filter_audit.query(odd, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 64, 1000, 4099])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint32)
    assert filter_audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


# --- vector codes -------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, of int"


def _codes(rows, parts=16, entries=64, rounds=2):
    whole = [(k, [int(np.floor(256 * float(x))) for x in v], label) for k, v, label in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not whole:
        return []
    size = len(whole[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in whole]
    firsts = sorted(range(len(whole)), key=lambda i: (whole[i][0] is None, whole[i][0] or 0, whole[i][1]))[:entries]
    books = [[cut[i][p] for i in firsts] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(p, c[p])[1], []).append(c[p])
            for i, xs in groups.items():
                books[p][i] = [sum(column) // len(xs) for column in zip(*xs)]
    final = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    digest = vector_codes.hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in final]
    total = {}
    for (_, _, label), e in zip(whole, errors):
        total[label] = total.get(label, 0) + e
    return [(k, "".join(f"{i:02x}" for _, i in f), e, total[label], digest) for (k, _, label), f, e in zip(whole, final, errors)]


def _vectors(n, seed, digits=1):
    """Few distinct values, so that distances tie and vectors repeat."""
    rng = random.Random(seed)
    return [(i, [round(rng.uniform(-0.2, 0.2), digits) / 8 for _ in range(32)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "digits"), [(0, 1), (1, 1), (40, 1), (300, 1), (300, 3)])
def test_codes_equal_brute_force(spark, n, digits):
    rows = _vectors(n, n, digits)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 0), (1001, [None] * 32, 1), (1002, [nan] + [0.0] * 31, 1), (1003, [inf] * 32, None), (-5, [-inf] + [1.0] * 31, 2)]
    odd += [(None, r[1], r[2]) for r in rows[:2]] + rows[3:5] + [(r[0], [x + 0.25 for x in r[1]], 7) for r in rows[5:7]]
    every = rows + odd
    random.Random(1).shuffle(every)
    df = spark.createDataFrame([(*r, "c", "e", 1) for r in every], VECTORS).repartition(4)
    got = sorted((tuple(r) for r in vector_codes.query(df).collect()), key=str)
    assert got == sorted(_codes(every), key=str)


def test_search_sees_equal_distances():
    """Entries of one sum, repeated entries, and parts whose bound equals the best distance."""
    rng = np.random.default_rng(3)
    for width in (1, 2, 4):
        entries = rng.integers(-3, 4, (50, width))
        book, parts = vector_codes.Codebook.of(entries), rng.integers(-6, 7, (500, width))
        index, best = book.nearest(parts)
        every = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (best == every.min(1)).all() and (index == every.argmin(1)).all()


def test_codes_keep_other_columns_and_decode(spark):
    rows = _vectors(100, 5, 3)
    df = spark.createDataFrame([(*r, "c", "e", 1) for r in rows], VECTORS)
    books = vector_codes.trained(df)
    coded = vector_codes.encoded(df, books).collect()
    assert coded[0]["of"] == 1 and len(coded) == 100
    for r in coded:
        whole = np.floor(np.array(r["embedding"], np.float32).astype(float) * 256).astype(int)
        assert ((vector_codes.decoded(r["code"], books) - whole) ** 2).sum() == r["error"]


def test_unfit_vectors_are_errors(spark):
    for bad in ([[1.0] * 16, [1.0] * 32], [[1.0] * 17], [[1e30] * 16]):
        df = spark.createDataFrame(list(enumerate(bad)), "vec_id int, embedding array<double>")
        with pytest.raises(Exception, match="several lengths|don't divide|too large"):
            vector_codes.encoded(df, vector_codes.trained(df)).collect()
