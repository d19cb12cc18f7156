import __spark_entry__ as entry
from ragscale.operators import bootstrap
from ragscale.schemas import BOOTSTRAP_RESAMPLES


def test_large_groups_use_the_default_resamples(spark, sf_dir, monkeypatch):
    asked, real = [], bootstrap.multinomial_ci
    monkeypatch.setattr(bootstrap, "multinomial_ci", lambda *a, **k: asked.append(k.get("n_resamples", BOOTSTRAP_RESAMPLES)) or real(*a, **k))
    entry.queries()["bootstrap_ci_exact_large_full"](spark, sf_dir)
    assert asked == [BOOTSTRAP_RESAMPLES] == [1000]
