import numpy as np
from stratalog.llm import url_filter
from stratalog.llm.labelled_urls import labelled_urls, names
from stratalog.llm.queries import RULES, url_model


def test_names_held_out_whole():
    """A name is in training with all its urls, or not at all; so only parts of names can carry over."""
    rng = np.random.default_rng(0)
    every = names()
    fold = rng.integers(0, 4, len(every))
    per = len(labelled_urls()) // len(every)
    train = [u for i, u in enumerate(labelled_urls()) if fold[i // per]]
    held = [u for i, u in enumerate(labelled_urls()) if not fold[i // per]]
    assert not {url_filter.split_url(u)[0].split(".example")[0].split(".")[-1] for u, _ in held} & {url_filter.split_url(u)[0].split(".example")[0].split(".")[-1] for u, _ in train}
    model = url_filter.train(train)
    right = [(model.score(*url_filter.split_url(u)) > 0) == bool(y) for u, y in held]
    assert np.mean(right) >= 0.95


def test_scores_on_the_jvm_and_in_python(spark):
    urls = [u for u, _ in labelled_urls()[::97]] + [None, "", "none", "http://", "http://É.com/ü?x#y", "http://x.net/fr/", "http://a.net/fr", "ftp://WWW.example.COM/en/" + "a" * 20_000, "http://a://b/c", "http://x?y/z://"]
    df = spark.createDataFrame([(i, u, "h", "p", "r", "v", 1) for i, u in enumerate([*urls, urls[0]])], "page_id int, url string, host string, path string, rule string, verdict string, `a.b` int")
    out = url_filter.filter_urls(df, RULES, url_model())
    assert out.columns == ["page_id", "url", "input_host", "input_path", "input_rule", "input_verdict", "a.b", "host", "path", "rule", "verdict"]
    for r in out.collect():
        host, path = url_filter.split_url(r.url)
        fit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name), default=None)
        verdict = best.verdict if best else "block" if url_model().score(host, path) > 0 else "allow"
        assert (r.host, r.path, r.rule, r.verdict, r.input_host) == (host, path, best.name if best else None, verdict, "h")
    assert url_filter.filter_urls(df.limit(0), RULES, url_model()).count() == 0
    assert url_filter.filter_urls(df, [], url_model()).where("rule is not null").count() == 0
