"""The pipeline stage by stage against plain Python, on odd rows and on a small table."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
import public_tokenizers
from celestile.llm import decontaminate, mixing, simhash, toxicity
from celestile.llm.scratch import Scratch


@pytest.fixture(scope="module", params=["odd", "small"])
def where(request, odd_dir, small):
    return odd_dir if request.param == "odd" else small


@pytest.fixture(scope="module")
def kept(spark, where):
    """What each stage returns, the documents first."""
    scratch = Scratch(spark, "test")
    out = [spark.read.parquet(f"{where}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(scratch.save(stage(spark, out[-1], where), name))
    return out


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_stages_keep_columns_and_whole_rows(kept):
    for before, after in zip(kept[:4], kept[1:5]):
        assert after.columns == before.columns
        assert not bag(after, *after.columns) - bag(before, *before.columns)


def test_toxicity(spark, where, kept):
    model = toxicity.fit(spark, kept[0], toxicity.training_labels(spark.read.parquet(f"{where}/labels.parquet")))
    want = Counter()
    for i, text in (tuple(r) for r in kept[0].select("doc_id", "text").collect()):
        if toxicity.probability(np.array([toxicity.evidence(*toxicity.passages(text, model), model)[0]]), model)[0] < 0.5:
            want[(i, text)] += 1
    assert bag(kept[1], "doc_id", "text") == want


def alike(texts):
    """Pairs of texts whose sets of five-word shingles, as strings, have a Jaccard similarity of 0.8 or more."""
    sets = [set(simhash.shingles(simhash.words(t), 5)) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b) if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) else False
    return [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] == sets[j] or near(sets[i], sets[j])]


def test_near_copies(kept):
    """All pairs, by the definition."""
    docs = [tuple(r) for r in kept[1].select("doc_id", "text").collect()]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    found = simhash.sets(pa.array([t for _, t in docs], pa.string()), 5)
    close = [(i, j) for j in range(len(docs)) for i in range(j) if (int(found.fp[i]) ^ int(found.fp[j])).bit_count() <= 4 and np.bitwise_count(found.wide[i] ^ found.wide[j]).sum() <= 46]
    for i, j in alike([t for _, t in docs]) + close:
        top[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(docs):
        groups[find(i)].append(k)
    want = Counter(min((x for x in g if x is not None), default=None) for g in groups.values())
    assert Counter(r[0] for r in kept[2].select("doc_id").collect()) == want


def test_near_copies_of_every_kind(spark):
    """Appended, truncated and scattered edits against brute-force Jaccard."""
    rnd = random.Random(5)
    some = lambda n: [f"w{int(rnd.paretovariate(0.6)) % 30000}" for _ in range(n)]
    texts = []
    for n in range(60):
        w = some(rnd.randint(60, 900))
        cut = round(len(w) * rnd.uniform(0.1, 0.22))
        spots = set(rnd.sample(range(len(w)), max(1, len(w) // 60)))
        texts += [w, w + some(cut), w[:-cut], [f"x{i}" if i in spots else x for i, x in enumerate(w)]]
    texts = [" ".join(w) for w in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(spark, docs, width=5, max_distance=4, check_distance=46).collect()}
    pairs = alike(texts)
    assert len(pairs) > 60 and all(got[i] == got[j] for i, j in pairs)
    assert all(i // 4 == c // 4 for i, c in got.items())


def test_sets_in_pieces():
    """Prints of long texts, cut on the way, and of none."""
    rnd = random.Random(1)
    texts = [" ".join(str(rnd.randint(0, 50)) for _ in range(n)) for n in (30_000, 0, 3, 4, 5, 9_000, 1)] + [None, " A b\tc  d E f"]
    whole = simhash.sets(pa.array(texts, pa.string()), 5)
    for i, t in enumerate(texts):
        one = simhash.sets(pa.array([t], pa.string()), 5)
        w = simhash.shingles(simhash.words(t), 5)
        assert whole.at[i + 1] - whole.at[i] == one.at[1] == len(set(w))
        for a, b in ((whole.fp, one.fp), (whole.wide, one.wide), (whole.sig, one.sig), (whole.bands, one.bands)):
            assert (a[i] == b[0]).all()
    assert whole.sig[1] == 0 and len(set(whole.sig.tolist())) == len(texts) - 1


def test_leaks(spark, where, kept):
    bench = [tuple(r) for r in spark.read.parquet(f"{where}/benchmark.parquet").select("item_id", "text").collect()]
    m = decontaminate.Matcher([x for x in bench if x[1]])
    want = Counter((i, t) for i, t in (tuple(r) for r in kept[2].select("doc_id", "text").collect()) if not m.find(t))
    assert bag(kept[3], "doc_id", "text") == want


def test_mixing_meets_its_targets(kept):
    """The draw repeats from the cells' probabilities, and these hold the marginals."""
    spark = kept[0].sparkSession
    sized = mixing.sized(kept[3]).cache()
    cells = mixing.rake(sized, Scratch(spark, "test"))
    p = {tuple(r[:3]): r["probability"] for r in cells.select(*mixing.DIMENSIONS, "probability").collect()}
    import hashlib

    rows = sized.select("doc_id", *mixing.DIMENSIONS, "tokens").collect()
    draw = lambda i: int(hashlib.md5(str(i).encode() if i is not None else b"").hexdigest()[:12], 16) / (1 << 48)
    sure = [r for r in rows if abs(draw(r["doc_id"]) - p[tuple(r[1:4])]) > 1e-6]
    want = Counter(r["doc_id"] for r in sure if draw(r["doc_id"]) < p[tuple(r[1:4])])
    got = Counter(r[0] for r in kept[4].select("doc_id").collect())
    assert not want - got and sum((got - want).values()) <= len(rows) - len(sure)
    total = sum(r["tokens"] for r in rows)
    assert abs(sum(r["tokens"] * p[tuple(r[1:4])] for r in rows) - 0.5 * total) < 1e-3 * total


def test_tokens(kept):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in (tuple(r) for r in kept[4].select("doc_id", "text").collect()):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert bag(kept[5], "doc_id", "n_tokens", "ids_crc32") == want


def test_empty_tables(spark, empty_dir):
    assert P.run(spark, empty_dir).collect() == []
