from test_cotrain import make

from ragscale.llm import cotrain


def test_surest_come_from_the_whole_corpus(spark, monkeypatch):
    """With a labelled sample of 40 the surest of all unlabelled documents are taught, as in memory over everything."""
    docs, labels, _ = make(spark, 300)
    asked, real = [], cotrain._fetched
    monkeypatch.setattr(cotrain, "_fetched", lambda mine, ids: asked.append([tuple(r) for r in ids.collect()]) or real(mine, ids))
    cotrain.learn(docs, labels, sample=40, rounds=1, share=0.5, most=60)
    given = {r.doc_id for r in labels.where("quality in (0, 1)").collect()}
    pool = {r.doc_id for r in docs.collect() if r.doc_id is not None} - given
    taught = {i for i, _ in asked[1]}
    assert len(asked[0]) == 40 and taught <= pool and len(taught) > 40
    first = cotrain.learn(docs, labels, sample=40, rounds=0)
    rows = [r for r in cotrain.score(docs, first, ["doc_id"]).collect() if r.doc_id in pool]
    top = {round(r.text_score, 7) for r in sorted(rows, key=lambda r: -r.text_score)[:20]}
    assert top <= {round(r.text_score, 7) for r in rows if r.doc_id in taught}


def test_repeated_ids_come_once(spark, monkeypatch):
    docs, labels, _ = make(spark, 60)
    hot = docs.where("doc_id = 3").selectExpr("doc_id", "text", "source", "lang", "n_chars", "score", "k0", "explode(sequence(1, 500)) as n")
    other = hot.selectExpr("doc_id", "concat(text, n % 7) as text", "source", "lang", "n_chars", "score", "k0")
    sizes, real = [], cotrain._fetched
    monkeypatch.setattr(cotrain, "_fetched", lambda mine, ids: (sizes.append((ids.count(), len((got := real(mine, ids))[0]))), got)[1])
    cotrain.learn(docs.unionByName(other), labels, sample=40, rounds=1)
    assert sizes and all(got <= asked for asked, got in sizes)
