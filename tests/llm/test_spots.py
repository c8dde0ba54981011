import hashlib

import numpy as np
from pyspark.sql import functions as F

from wordreel.llm import spots


def parts(fingerprint):
    return {fingerprint[i:i + 8] for i in range(0, len(fingerprint), 8)}


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(df, rows):
    """Every row's digests and likenesses by plain code, from the fingerprints themselves."""
    got = sorted(spots.compare_edits(df).collect(), key=lambda r: (r["doc_id"] is not None, r))
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(rows)
    found = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in got}
    of = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        text = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = found[(i, len(t), hashlib.sha256(text.encode()).hexdigest())]
        assert of.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert of.setdefault(text, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert abs(r["near_edited"] - like(parts(r["fingerprint"]),
                                           parts(r["edited_fingerprint"]))) < 1e-12
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        text = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = found[(i, len(t), hashlib.sha256(text.encode()).hexdigest())]
        assert abs(r["near_next"] - like(parts(of[t]), parts(of[after]))) < 1e-12
    return of


def test_given_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check(documents, rows)


def test_odd_rows(odd, empty, spark):
    of = check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert of[""] == "" and of["one"] != of["!!! ..."]
    assert spots.compare_edits(empty).count() == 0
    alone = spark.createDataFrame([(5, "the only text")], "doc_id bigint, text string")
    check(alone, [(5, "the only text")])


def test_ids_far_apart(spark):
    rows = [(i * 10**15 - 10**17, f"the text {i} of many and more") for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), rows)


def test_ids_beyond_doubles(spark):
    ids = [r[0] for r in spark.range(300).select(F.xxhash64("id")).collect()]
    rows = [(i, f"the text {k} of many and more") for k, i in enumerate(ids)]
    rows += [(2**63 - 1, "the last of all"), (-(2**63) + 1, "the first of all"), (None, "no id")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), rows)


def test_one_id_of_most_rows_is_cut(spark):
    """Rows that share a null or a repeated id lie in many parts, in the order of their texts."""
    rows = [(None, f"the text {i * 7919 % 3000:04d} of one and no id") for i in range(3000)]
    rows += [(9, f"a text {i % 700:04d} with the id of all") for i in range(1500)]
    rows += [(i, f"the text {i} of many") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    check(df, rows)
    sizes = [r["count"] for r in spots.with_next(df).filter("not halo").groupBy("part").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < len(rows) / 6


def test_signatures_are_spots_with_chains():
    s = spots.Spotter(["the", "of"], chain=2)
    keys = s.sets(["the red house of stone", "the red house of stone", "of stone", "x", ""])
    n = np.bincount((keys >> np.uint64(32)).astype(int), minlength=5).tolist()
    assert n == [2, 2, 1, 1, 0]
    assert spots.likeness(keys, keys, 5).tolist() == [1.0] * 5
    # punctuation and case do not count, another word does
    a, b, c = spots.fingerprints_of(s.sets(["The red house.", "the RED, house", "the red horse"]), 3)
    assert a == b != c


def test_search_finds_all_partners(documents, spark):
    base = documents.limit(60).select("doc_id", "text")
    near = base.select((F.col("doc_id") + 10**6).alias("doc_id"),
                       F.concat("text", F.lit(" the end of it")).alias("text"))
    rows = spots.fingerprints(base.unionByName(near))
    sets = {r["doc_id"]: set(r["signatures"]) for r in rows.collect()}
    queries = rows.filter("doc_id % 5 = 0")
    got = {(r["query_id"], r["doc_id"]): r["likeness"]
           for r in spots.search(queries, rows, 0.7).collect()}
    want = {(a, b): like(sets[a], sets[b]) for a in sets if a % 5 == 0 for b in sets
            if a != b and sets[a] and sets[b] and like(sets[a], sets[b]) >= 0.7}
    assert got == want and len(want) > 5
