import math
import random
from collections import defaultdict

import numpy as np
import pytest

from ranksmith.llm import language_id as L

WORDS = {"en": "the and of to in that with house river green".split(), "de": "der die und nicht über schön straße haus fluß".split(), "fr": "le la et être où maison rivière vert français".split()}


def text(rng, lang, n=40):
    return " ".join(rng.choices(WORDS[lang], k=n)).capitalize()


def training(spark):
    rng = random.Random(0)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)] + [(None, "zzz", "en"), (900, None, "de"), (901, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def slow_means(model, t):
    raw = b" " + t.encode().translate(L._NORMAL) + b" "
    grams = [raw[i : i + 3] for i in range(len(raw) - 2) if raw[i + 1] != 32]
    rows = [model.table[((int.from_bytes(g, "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 17] for g in grams]
    return (np.mean(rows, axis=0) if rows else np.zeros(len(model.languages))), len(rows)


def test_fusion_matches_a_slow_version(spark):
    model = L.train(training(spark))
    assert model.languages == ("de", "en", "fr")
    rng = random.Random(1)
    pages = []
    for i in range(60):
        lang = rng.choice(["en", "de", "fr"])
        words = rng.choice([text(rng, lang, 30), text(rng, lang, 1), "", "42 %", "qxqx " * 30])
        host = rng.choice(["a.x.de", "b.x.de", "y.com", "z.fr", "", "z.co.uk"])
        declared = rng.choice([lang, "en", "xx", None])
        html = f"<html{'' if declared is None else f' lang=\"{declared.upper()}-X\"'}><script>var the=1</script><p>{words}&amp;</p>"
        pages.append((i, f"http://{host}/p" if host else None, html))
    pages.append((None, "http://a.x.de/", None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in L.identify_pages(df, model).collect()}
    lang_of, logs, keys, means = model.languages, {}, {}, {}
    for i, url, html in pages:
        t = "" if html is None else html.split("<p>")[1].split("&amp;")[0]
        m, n = slow_means(model, t)
        declared = html.split('lang="')[1][:2].lower() if html and "lang=" in html else None
        host = url.split("/")[2] if url else ""
        suffix = L.SUFFIXES.get(host.split(".")[-1])
        e = m * min(n, L.EFFECTIVE)
        for given, right in ((declared, L.DECLARED_RIGHT), (suffix, L.SUFFIX_RIGHT)):
            if given in lang_of:
                e = e + np.log([right if x == given else (1 - right) / 2 for x in lang_of])
        logs[i], means[i] = e, (m, n, declared, suffix)
        keys[i] = [(), (host.split(".")[-1],), (host.split(".")[-1], ".".join(host.split(".")[-2:])), (host.split(".")[-1], ".".join(host.split(".")[-2:]), host)]
    own = {i: np.exp(e - e.max()) / np.exp(e - e.max()).sum() for i, e in logs.items()}
    sums = defaultdict(lambda: np.zeros(3))
    for i, ks in keys.items():
        for k in ks:
            sums[k] += own[i]
    for i, e in logs.items():
        prior = np.ones(3) / 3
        for k in keys[i]:
            rest = np.maximum(sums[k] - own[i], 0)
            prior = (rest + L.STRENGTH * prior) / (rest.sum() + L.STRENGTH)
        p = e + np.log(prior)
        p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
        m, n, declared, suffix = means[i]
        evidence = n > 0 or declared in lang_of or suffix in lang_of
        und = not evidence or p.max() < 0.5 or (n >= L.EFFECTIVE and m.max() < model.floor)
        assert got[i].language == ("und" if und else lang_of[p.argmax()])
        assert got[i].confidence == pytest.approx(p.max()) and got[i].prior == pytest.approx(prior[p.argmax()])
    assert {r.language for r in got.values()} == {"de", "en", "fr", "und"}


def test_held_out_accuracy_filter_and_clashing_columns(spark):
    model = L.train(training(spark))
    rng = random.Random(7)
    rows = [(i, text(rng, lang), lang, None if i % 5 else "s", "x", i) for i, lang in enumerate(["en", "de", "fr"] * 20)] + [(100, None, "en", "s", "x", 1), (101, " 12 -", "en", "s", "x", 1), (102, "qxq wvw " * 40, "en", None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language string, _own int")
    out = L.identify(docs, model, docs.text, [docs.source], keep=["doc_id", "lang"]).collect()
    assert sum(r.language == r.lang for r in out) == 60
    kept = L.keep_known_languages(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_empty_tables(spark):
    none = L.train(training(spark).limit(0))
    pages = spark.createDataFrame([(1, "http://a.de/", "<html lang=de>x")], "page_id long, url string, html string")
    assert L.identify_pages(pages, none).first().language == "und"
    model = L.train(training(spark))
    assert L.identify_pages(pages.limit(0), model).count() == 0
    assert math.isclose(sum(np.exp(model.table[:, 0])), 1.0)
