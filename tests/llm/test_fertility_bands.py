import random
import string

import public_tokenizers

from ragscale.llm.fertility import learned_rules

PATHS = [str(public_tokenizers.path(n)) for n in ("piece_bpe_32k.model", "word_bpe_49k.json")]


def test_noise_is_rejected_and_prose_kept(spark):
    rng = random.Random(6)
    words = "the old river carried water from distant mountains toward quiet villages where farmers planted wheat and barley every spring before heavy rains arrived over fields gardens merchants traded copper silver cloth honey".split()
    rows = [(i, " ".join(rng.choices(words, k=200)), "en") for i in range(600)]
    rows += [(1000 + i, " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(200)), "en") for i in range(20)]
    rows += [(2000 + i, " ".join("".join(chr(rng.randint(0x1F300, 0x1F64F)) for _ in range(4)) for _ in range(200)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    kept = {r.doc_id for r in learned_rules(docs, *PATHS, ["doc_id"]).where("kept").collect()}
    assert len(kept & set(range(600))) >= 590 and max(kept) < 600


def test_few_documents_lean_on_the_prior(spark):
    words = "quiet villages where farmers planted wheat and barley every spring before rains arrived over their gardens".split()
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words, k=80)), None) for i in range(3)] + [(9, None, None)]
    got = {r.doc_id: r.kept for r in learned_rules(spark.createDataFrame(rows, "doc_id int, text string, lang string"), *PATHS, ["doc_id"]).collect()}
    assert got == {0: True, 1: True, 2: True, 9: False}
    assert learned_rules(spark.createDataFrame([], "doc_id int, text string, lang string"), *PATHS, ["doc_id"]).count() == 0
