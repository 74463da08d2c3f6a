"""Operators over the whole corpus and the pipeline, against brute force."""

import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gatherum.llm import near_dedup, shards, substring_dedup

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


def groups(docs, n, num, den):
    """Component of each id by comparing all pairs."""
    sets = {}
    for key, text in docs:
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[key] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1) if w else 0)}
    at = {k: k for k in sets}

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            at[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def near_texts(seed=1):
    """Chains and stars of near copies, exact copies, short texts."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 400))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)]
    for base in list(texts):
        for _ in range(rng.randint(0, 4)):
            w = base.split()
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = word()
            base = " ".join(w)
            texts.append(base.upper() if rng.random() < 0.3 else base)
    return texts + ["", None, " \t", "a", "A", "a b", "a b c", "a b"]


def check_near(spark, texts, **conf):
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs + [(None, texts[0])], "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("digest", F.lit(0))
    rows = near_dedup.near_duplicates(frame, **conf).collect()
    got = {r["key"]: (r["n_shingles"], r["component_id"]) for r in rows if r["key"] is not None}
    assert got == groups(docs, *conf.values())
    assert all(r["kept"] == (r["key"] == r["component_id"]) for r in rows if r["key"] is not None)
    assert [(r["component_id"], r["kept"]) for r in rows if r["key"] is None] == [(None, True)]


def test_near_duplicates_are_brute_force(spark):
    check_near(spark, near_texts(), n=3, num=85, den=100)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)  # buckets of several blocks
    check_near(spark, near_texts(2), n=2, num=60, den=100)


def test_near_duplicates_with_equal_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "x y z"), (2, "x y z")], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs, n=3).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False)]
    assert near_dedup.near_duplicates(docs.filter("false")).count() == 0


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        guesses = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
            k = int(1000 * share)
            a, b = pool[:1000], np.concatenate([pool[:k], pool[1000 : 2000 - k]])
            one, two = near_dedup.signature(a), near_dedup.signature(b)
            guesses.append(near_dedup.estimate(one, two[None])[0])
        assert abs(np.mean(guesses) - share / (2 - share)) < 0.02


def test_short_near_copies_share_a_band():
    rng = np.random.default_rng(0)
    for small, large, pairs in ((4, 5, 3000), (6, 7, 8000), (8, 10, 3000)):  # missed 7.9e-3, 1.6e-3, 8e-4 when bands read half
        for hashes in rng.integers(0, 1 << 64, (pairs, 10), dtype=np.uint64):
            one, two = (near_dedup.signature(hashes[:k]) for k in (small, large))
            assert (near_dedup.band_hashes(one) == near_dedup.band_hashes(two)).any()


def kept_words(docs, n):
    """Texts in order of (id, hash of the text), windows remembered as they come."""
    seen, out = {}, {}
    key = lambda d: (d[0] is not None, d[0], substring_dedup._text_tag((d[1] or "").encode()))
    for doc, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, substring_dedup._text_tag((d[1] or "").encode()))):
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            window = tuple(w[i : i + n])
            if window in seen:
                gone[i : i + n] = [True] * n
            seen.setdefault(window, key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(doc, text)] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def passage_texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "v" + str(rng.randint(0, 50))
    passages = [[word() for _ in range(rng.randint(8, 30))] for _ in range(4)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randint(0, 15))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    return texts + [texts[3], texts[3], "p q " * 40, "same " * 3000, "same " * 20, "", None, "é " * 30, "z " * 9]


def check_cuts(spark, docs, n):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for name in ("id", "body", "removed", "ranges", "tag"):
        frame = frame.withColumn(name, F.lit(5))
    rows = substring_dedup.remove_repeats(frame, n).collect()
    want = kept_words(docs, n)
    assert len(rows) == len(docs)
    for r in rows:
        key = (r["row"]["doc_id"], r["row"]["text"])
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[key], key


def test_repeats_are_brute_force(spark):
    check_cuts(spark, list(enumerate(passage_texts())), 8)


def test_repeats_with_crowded_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_VARIANTS", 2)
    check_cuts(spark, list(enumerate(passage_texts(9))), 8)


def test_repeats_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # groups run over batches
    try:
        check_cuts(spark, list(enumerate(passage_texts(11))), 8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_with_equal_and_null_ids(spark):
    texts = passage_texts(12)
    docs = [(i // 3 if i % 7 else None, t) for i, t in enumerate(texts)]
    check_cuts(spark, docs + docs[:5], 8)


def test_matching_statistics():
    rng = random.Random(2)
    machine, before = substring_dedup.SuffixAutomaton(), []
    for _ in range(30):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))]
        got = machine.stream(words)
        for i in range(len(words)):
            ends = [t[: j + 1] for t in before for j in range(len(t))] + [words[: j + 1] for j in range(i)]
            want = max((k for k in range(i + 2) if any(e[len(e) - k :] == words[i + 1 - k : i + 1] and len(e) >= k for e in ends)), default=0)
            assert got[i] == want
        before.append(words)


def least_capacity(sizes, k):
    """Smallest largest run over all ways to cut a sequence into k runs."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, runs, room = (low + high) // 2, 1, 0
        for s in sizes:
            if room + s > mid:
                runs, room = runs + 1, 0
            room += s
        low, high = (low, mid) if runs <= k else (mid + 1, high)
    return low


def check_shards(spark, docs, k, cells=4):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("cell", F.lit(1))
    rows = shards.assign(frame, shards=k, cells=cells).collect()
    assert len(rows) == len(docs)
    sizes, order = {}, {}
    for key, text in docs:
        digest = "" if text is None else hashlib.md5(text.encode()).hexdigest()
        sizes[digest] = sizes.get(digest, 0) + len((text or "").encode()) + 16
        order[(key, text)] = digest
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r)
    for own in held.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    want = least_capacity([sizes[d] for d in sorted(sizes)], k)
    assert max(sum(r["size"] for r in own) for own in held.values()) == want
    return rows


def test_shards_are_minimax(spark):
    rng = random.Random(6)
    texts = ["t" * rng.randint(0, 300) + str(rng.randint(0, 200)) for _ in range(400)] + ["hot copy"] * 150 + [None, "", None]
    check_shards(spark, list(enumerate(texts)) + [(3, "same id")], 7)


def test_shards_refine_until_cuts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(shards, "FIRST", 1)  # sixteen cells first, so cuts fall inside
    rng = random.Random(8)
    check_shards(spark, [(i, "u" * rng.randint(0, 90) + str(i)) for i in range(700)], 9)


def test_shards_keep_groups_together_and_few_rows(spark):
    rows = check_shards(spark, [(i, f"text {i % 5}") for i in range(60)], 40)
    assert len({(r["text_crc32"], r["shard"]) for r in rows}) == 5
    assert shards.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "SentencePiece encoding"]
    junk = spark.createDataFrame([(10**6, "1234 --- 5678"), (10**6 + 1, None)], "doc_id long, text string")
    docs = docs.unionByName(junk, allowMissingColumns=True)
    first = corpus_pipeline.identify_language(spark, docs, SF)
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in first.collect()} >= {10**6, 10**6 + 1}
    assert first.count() >= 0.99 * (docs.count() - 2)

    rows = first.select("doc_id", "text").collect()
    second = corpus_pipeline.drop_near_copies(spark, first, SF)
    best = {root for _, root in groups([tuple(r) for r in rows], 5, 80, 100).values()}
    assert {r["doc_id"] for r in second.collect()} == best and second.columns == docs.columns

    third = corpus_pipeline.cut_repeats(spark, second, SF)
    want = kept_words([(r["doc_id"], r["text"]) for r in second.collect()], 20)
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    for (key, text), (n, gone, digest) in want.items():
        if gone and gone == n:
            assert key not in texts
        elif gone:
            assert hashlib.sha256(texts[key].encode()).hexdigest() == digest
        else:
            assert texts[key] == text

    fourth = corpus_pipeline.decontaminate_benchmark(spark, third, SF)
    assert fourth.columns == docs.columns
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    from gatherum.llm import decontaminate

    hit = {r["row"]["doc_id"] for r in decontaminate.find(third, items).collect() if r["spans"]}
    after = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert hit and all(after.get(k) != texts[k] for k in hit)
    assert all(after[k] == t for k, t in texts.items() if k not in hit)

    last = corpus_pipeline.encode_pieces(spark, fourth, SF).collect()
    assert {r["doc_id"] for r in last} == set(after)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) > 0 for r in last)


def test_run_is_the_stages_in_a_row(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert 0 < got.count() <= 200


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    """Null and repeated ids, null and empty texts, clashing columns, no ``n_chars``, and an empty table."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en"), (2, words + " more", "en"), (None, words, "en"), (3, None, "en"), (4, "", None), (5, "12 !", "en"),
            (5, "plain words here", "en"), (6, "plain words here", None), (6, "plain words here", None)]
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("key", "row", "id", "ids", "kept", "component_id", "n_words", "spans", "score"):
        docs = docs.withColumn(name, F.lit(1))
    for frame in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == frame.columns
            frame = out
        coded = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
        assert all(r["round_trip"] for r in coded)
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [0, 1, 2, 5, 6, 6]


def test_null_ids_are_dealt_by_their_text(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words))] * 2 + [(None, " ".join(words[5:] + ["x"])), (7, " ".join(words[:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["row"]["text"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()]
    assert (rows[3][1], 30) in got  # a null id comes before all others
    lost = dict(got)
    assert sorted((lost[rows[0][1]], lost[rows[2][1]])) == [0, 35]  # one of the two comes first
    assert [x for x in got if x[0] == rows[0][1]] == [(rows[0][1], lost[rows[0][1]])] * 2
