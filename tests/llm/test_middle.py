import hashlib
import random
import re

import numpy as np
import pytest

from ragscale.llm.middle import fill_in_middle, restore, restored_texts, transform

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    alphabet = ["a", "bc", "ü", "漢字", "😀", " ", "  ", "\n", "\t ", "\x0b", "\xa0", "<", ">", "P", "<P", "S>", "<M", "\x1c"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "   "), (503, "<P>"), (504, "one <S> two"), (505, "x<M>"), (None, "no id here"), (None, None), (-7, "minus seven words"), (3, "again"), (3, "again")]
    rows += [(600 + i, "<" * i + " P> <" * i) for i in range(6)]
    return rows + [(700 + i, "word ünd " * 200_000 + " ") for i in range(3)]  # longer than a slice


def key(row):
    return [(x is None, str(x)) for x in row]


def test_outputs_and_round_trip(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id bigint, text string, n int, form string").repartition(5)
    made = fill_in_middle(docs, ["doc_id", "text", "form"])  # ``form`` of the table is left out
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = restored_texts(made, made.columns).collect()
    want = sorted((brute(i, t) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want
    assert all(r.restored == (r.text or "") for r in got)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_empty_table_and_shares(spark):
    docs = spark.createDataFrame(texts()[:200], "doc_id bigint, text string")
    assert fill_in_middle(docs.limit(0), ["doc_id"]).count() == 0
    forms = {r.form for r in fill_in_middle(docs.where("text <> ''"), [], rate=100, spm_share=0).where("output not like '%<P>%<P>%'").collect()}
    assert forms <= {"psm", "plain"} and "psm" in forms
    assert {r.form for r in fill_in_middle(docs, [], rate=0).collect()} == {"plain"}


def test_a_lost_mark_is_noticed():
    data = np.frombuffer(b"<P>a<S>b c", np.uint8)
    with pytest.raises(ValueError, match="mark"):
        restore(data, np.array([0, len(data)]), np.array([1]))
    flat, offsets = transform(np.frombuffer(b"abc", np.uint8), np.array([0, 0, 3, 3]), np.array([0, 2, 0]), np.array([0, 1, 3]), np.array([0, 2, 3]))
    assert flat.tobytes() == b"<S>c<P>a<M>b" and offsets.tolist() == [0, 0, 12, 12]
