import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from ragscale.llm.fertility import BANDS, fertility_rules

VOCABULARY = str(public_tokenizers.path("piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    model = SentencePieceProcessor(model_file=VOCABULARY)
    tokens = [t for w in words for t in model.encode(w)]
    n = len(tokens)
    spread = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())
    even = spread / math.log2(min(n, model.vocab_size())) if n > 1 else 1.0
    per = sum(map(len, words)) / max(n, 1)
    share = sum(model.is_byte(t) for t in tokens) / max(n, 1)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, n, per, share, even)


def texts():
    rng = random.Random(9)
    words = ["one", "two", "drei", "vier,", "été", "中文", "x", "###", "Ünï", "<b>", "a|b", " nb", "𝒳"]
    out = [None, "", " ", "\n\n", "a", "a b", "a b c a b c", "x " * 200, "line one\nline one\n\n \nline one\r\nline two", "中" * 500, "abc " * 30 + "d e f g " * 20]
    for n in (49, 50, 51, 120, 400):
        for k in (3, 13):
            out.append("".join(rng.choice(words[:k]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(n)))
    for _ in range(40):
        block = " ".join(rng.choices(words, k=rng.randint(1, 12)))
        out.append("\n".join(rng.choice([block, " ".join(rng.choices(words, k=9))]) for _ in range(rng.randint(1, 30))))
    return out


@pytest.mark.parametrize("slice_bytes", [1, 16 << 20])
def test_against_brute_force(spark, slice_bytes):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "k", 1, True) for i, t in rows], "doc_id bigint, text string, x0 string, k0 int, t boolean").coalesce(2)
    got = {r.doc_id: r for r in fertility_rules(docs, VOCABULARY, ["doc_id", "x0"], slice_bytes=slice_bytes).collect()}
    for i, text in rows:
        r, want = got[i], brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_tokens) == want[:7], text
        assert (r.chars_per_token, r.byte_share, r.evenness) == pytest.approx(want[7:])
        low, high, most, least = BANDS[r.script]
        assert r.kept == (not r.base_failed and low <= r.chars_per_token <= high and r.byte_share <= most and r.evenness >= least)


def test_scripts_and_bands(spark):
    prose = "Ancient rivers carried water from distant mountains toward quiet villages where farmers planted wheat and barley every spring before heavy rains arrived over their fields and gardens while merchants traded copper silver cloth honey spices and painted pottery along dusty roads connecting busy harbours with remote inland markets near forests full of oak pine cedar"
    rng = random.Random(3)
    junk = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(12)) for _ in range(150))
    rows = [(1, prose), (2, junk), (3, " ".join(f"слово{i}" for i in range(99))), (4, " ".join("中文字" + chr(0x4E00 + i) for i in range(99)))]
    got = {r.doc_id: (r.script, r.kept) for r in fertility_rules(spark.createDataFrame(rows, "doc_id int, text string"), VOCABULARY, ["doc_id"]).collect()}
    assert got[1] == ("latin", True) and got[2] == ("latin", False) and got[3][0] == "cyrillic" and got[4][0] == "han"


def test_no_documents(spark):
    assert fertility_rules(spark.createDataFrame([], "doc_id int, text string"), VOCABULARY, ["doc_id"]).collect() == []
