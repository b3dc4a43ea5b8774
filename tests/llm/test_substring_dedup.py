import hashlib
import random
from collections import Counter

from ranksmith.llm.substring_dedup import digests, remove_repeats


def brute(texts, k):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = ["a", "b", "the", "é", "ß", "word", "x,y"] + [f"w{i}" for i in range(40)]
    passage = [rng.choice(vocab) for _ in range(30)]
    texts = [None, "", "  \t\n", "one", "ha " * 60, "one two " * 25]
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 5) : rng.randint(15, 30)]
        texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(w))
    return texts + texts[10:14] + [" ".join(passage * 20)]


def test_matches_brute_force_with_and_without_hot_buckets(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, mh string").repartition(3).cache()
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    want = dict(enumerate(brute(texts, 8)))
    for bucket in (2048, 2):
        got = digests(docs, k=8, m=3, max_bucket=bucket).collect()
        assert sorted(r.doc_id for r in got) == sorted(ids)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_null_and_repeated_ids_and_clashing_columns(spark):
    a, b = " ".join(f"p{i}" for i in range(40)), " ".join(f"q{i}" for i in range(40))
    rows = [(None, a, "1"), (7, a, "2"), (7, b, "3"), (7, "tail " + b, "4"), (8, None, "5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").coalesce(1)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in digests(docs).collect())
    assert got == Counter([(None, 40, 40), (7, 40, 40), (7, 40, 40), (7, 41, 40), (8, 0, 0)])
    kept = {r._row: r.text for r in remove_repeats(docs).collect()}
    assert kept == {"1": "", "2": "", "3": "", "4": "tail", "5": None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert digests(docs).count() == 0 and remove_repeats(docs).count() == 0


def test_results_hold_when_partitions_move_between_passes(spark, tmp_path):
    """The files are split otherwise when the result is read than when the intermediate tables were written."""
    texts = corpus(8) * 3
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.option("parquet.block.size", 2048).parquet(path)
    want = dict(enumerate(brute(texts, 8)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "100m")
        got, kept = digests(spark.read.parquet(path), k=8, m=3), remove_repeats(spark.read.parquet(path), k=8, m=3)
        spark.conf.set(name, "3k")
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == want
        assert {r.doc_id for r in kept.collect() if r.text is not None and hashlib.sha256(r.text.encode()).hexdigest() != want[r.doc_id][2]} <= {i for i, w in want.items() if w[1] == 0}
    finally:
        spark.conf.set(name, before)


def test_runs_of_one_word_and_texts_of_many_megabytes(spark):
    long = " ".join(f"x{i * 7919 % 65537}" for i in range(600_000))
    texts = ["same " * 9000, "same " * 5000 + "end", long, "head " + long[: 3 << 20].rsplit(" ", 1)[0], ("w" * 5000 + " ") * 40, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in digests(docs).collect()}
    n_long, n_head = 600_000, len(texts[3].split())
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {0: (9000, 9000), 1: (5001, 5000), 2: (n_long, n_long), 3: (n_head, n_head - 1), 4: (40, 40), 5: (0, 0)}
    assert got[3].kept_sha256 == hashlib.sha256(b"head").hexdigest() and got[1].kept_sha256 == hashlib.sha256(b"end").hexdigest()


def test_odd_column_names(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, passage, 5, 6), (2, passage + " rest", 7, 8)], "doc_id long, text string, `x.y` int, `a b` int")
    assert {tuple(r) for r in remove_repeats(docs).collect()} == {(1, "", 5, 6), (2, "rest", 7, 8)}
