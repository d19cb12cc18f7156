import hashlib
import re

from pyspark.sql import functions as F

from ragscale.llm.winnow import GRAM, PLACE, UNIT, WINDOW, edited_fingerprints, with_fingerprint

SCHEMA = "doc_id bigint, text string, n_chars int, fingerprint string, copy int"
WORDS = [f"w{i * 7919 % 613}" for i in range(400)]


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, -1, "clash", 9) for i, t in rows], SCHEMA)


def brute_edits(rows):
    """(id, edited text) of every row, with repeated rows following each other."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for at, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(at + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        out.append((i, t[: len(t) - q] + nxt[:q]))
    return out


ROWS = [
    (3, " ".join(WORDS[:120])), (1, " ".join(WORDS[100:300])), (7, None), (8, ""), (9, "ä"), (10, "one two three"),
    (11, "été " * 50), (12, " ".join(WORDS[:120])), (None, "no id here but words"), (20, "中文字" * 40), (21, "x" * 3000),
    (5, "same row again with words"), (5, "same row again with words"),
]


def test_edits_and_order(spark):
    got = edited_fingerprints(rows_of(spark, ROWS)).collect()
    want = sorted((str(i), hashlib.sha256(e.encode()).hexdigest()) for i, e in brute_edits(ROWS))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[3].n_chars == len(ROWS[0][1]) and by[3].fingerprint == by[12].fingerprint
    assert by[7].fingerprint == "" and by[7].near_edited == 1.0 and by[7].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert 0.4 < by[1].near_edited < 1 and by[1].near_next > 0


def test_selection_by_definition(spark):
    """Rightmost minima of every window, recomputed from the engine's own gram hashes."""
    texts = [" ".join(WORDS[:90]), "a b c d e f", "a b c", "z " * 60, ""]
    df = with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", "fp")
    got = {r.i: r.fp for r in df.select("i", "fp").collect()}
    for i, text in enumerate(texts):
        units = re.findall(r"\S{1,32}", text)
        grams = [units[a : a + GRAM] for a in range(max(1, len(units) - GRAM + 1))] if units else []
        hashed = [
            spark.range(1).select(F.xxhash64(F.transform(F.array(*map(F.lit, g)), lambda u: F.xxhash64(u))).alias("h")).first().h & 0xFFFFFFFF
            for g in grams
        ]
        want = []
        for a in range(max(1, len(hashed) - WINDOW + 1) if hashed else 0):
            at = max((j for j in range(a, min(a + WINDOW, len(hashed)))), key=lambda j: (-hashed[j], j))
            packed = (hashed[at] << 31) | (PLACE - at - 1)
            if packed not in want:
                want.append(packed)
        assert got[i] == want


def test_shared_run_is_always_seen(spark):
    run = WORDS[200 : 200 + GRAM + WINDOW - 1]
    texts = [" ".join(WORDS[:50] + run + WORDS[50:80]), " ".join(WORDS[300:333] + run + WORDS[340:360])]
    df = with_fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "fp")
    a, b = ({x >> 31 for x in r.fp} for r in df.collect())
    assert a & b


def test_unit_rule():
    assert UNIT.endswith("{1,32}")


def test_empty_and_single(spark):
    assert edited_fingerprints(rows_of(spark, [])).collect() == []
    only = edited_fingerprints(rows_of(spark, [(4, "abcdefgh")])).collect()[0]
    assert only.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and only.near_next == 1.0


def test_a_hot_row_is_counted_not_gathered(spark):
    """Three thousand copies of a row: all but the last are followed by a copy, the last by the next document."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text)] * 3000 + [(6, "other words follow here")] + [(None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = edited_fingerprints(docs).collect()
    mine = [r for r in got if r.doc_id == 5]
    assert len(got) == len(rows) and len(mine) == 3000 and len({r.fingerprint for r in mine}) == 1
    near = sorted(r.near_next for r in mine)
    assert near[0] == 0.0 and near[1:] == [1.0] * 2999
    assert sorted((r.doc_id is None, r.n_chars) for r in got if r.doc_id != 5) == [(False, 23), (True, 0), (True, 0)]
