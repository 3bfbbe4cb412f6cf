"""Each operator against a brute-force version, on odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, ngram_join, packing, sharding, sstable, topk, toxicity, transducer, urls
from quarry.llm.common import discard, shared_dir, stored
from quarry.llm.encoding import Encoder, Parts

WORDS = "the of and to in alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()
#: Columns whose names operators use inside.
CLASH = "n long, fp string, key string, part int, size long, score double, label int, sig long, block int, v string"


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", "s"]) for _ in range(n))


def odd_texts(seed=1):
    rng = random.Random(seed)
    base = text(rng, 60)
    near = base.replace("alpha", "ALPHA").split()
    near[-1] = "changed"
    out = [None, "", "   \n\t ", "one", "one two three four", base, base, base.upper(), " ".join(near), text(rng, 5000), "x" * 20_000, "é́ Σς 日本語 𝔘 \x00\x1c\x85 \u2003 tab\there"]
    out += [text(rng, rng.randint(1, 80)) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(odd_texts())]
    rows += [(None, "no id", None, None, None), (None, None, None, None, None), rows[5], rows[5]]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return odd.selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASH.split(", ")]).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- op1 -----------------------------------------------------------------------------------------
def best_segments(scores):
    """Ruzzo and Tompa's definition, by recursion: the best segment, then what is left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if best is None or total > best[2] + 1e-9:
                best = (i, j, total)
    if best is None or best[2] <= 0:
        return []
    i, j, s = best
    return best_segments(scores[:i]) + [(i, j, s)] + [(a + j + 1, b + j + 1, c) for a, b, c in best_segments(scores[j + 1 :])]


def test_all_maximal_segments():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.7, 2.0, 3.1]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in best_segments(scores)]
        assert all(math.isclose(s, sum(scores[a : b + 1])) for a, b, s in got)


def test_toxicity(spark, docs, none, sf):
    rng = random.Random(5)
    train = [(k, text(rng, 40) + (" vile scum" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(1000, 1600)]
    labelled = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    labels = labelled.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (7, None), (1000, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(labelled.select("doc_id", "text"), labels)
    assert min(model.scores["vile"], model.scores["scum"]) > 2 and all(model.scores[w] < 0.5 for w in WORDS[:5])
    scored = toxicity.score_documents(docs, model)
    assert scored.count() == docs.count() and scored.where("predicted = 1 or score < 0 or score > 1").count() == 0
    bad = spark.createDataFrame([(1, text(rng, 300) + " you vile scum " + text(rng, 300)), (2, text(rng, 300))], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(bad, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0
    assert got[1].passages[0].end - got[1].passages[0].start == len("vile scum")
    assert toxicity.score_documents(none, model).count() == 0
    # Plain words end a passage, and offsets are those of the text itself.
    apart = "İİİİ you VILE thing " + text(rng, 140) + " scum"
    spans = [(p.start, p.end) for p in toxicity.score_documents(spark.createDataFrame([(1, apart)], "doc_id long, text string"), model).first().passages]
    assert [apart[a:b] for a, b in spans] == ["VILE", "scum"]
    again = labelled.select("doc_id", "text").unionAll(labelled.select("doc_id", "text")).unionAll(spark.range(50).select(F.lit(1001).cast("long").alias("doc_id"), F.concat(F.lit("x"), "id").alias("text")))
    assert toxicity.labelled_texts(again, labels).count() <= 2 * 600 + toxicity.ROWS_OF_AN_ID
    assert toxicity.score_documents(bad, toxicity.fit(none, labels.limit(0))).where("predicted = 1").count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op1_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) >= 0.9


# --- op2 -----------------------------------------------------------------------------------------
def test_postings_stop_on_proof():
    """Vectors in tight groups: what a block gives, with or without a carried bound, is the plain product's best."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (12, 32))
    x = np.floor(centres[np.arange(3000) % 12] + rng.normal(0, 4, (3000, 32))).astype(np.int64)
    x[5] = x[17] = 0
    ids = rng.permutation(3000).astype(np.int64)
    index = topk.BlockIndex(ids, x)
    assert sum(index.end - index.begin) == np.count_nonzero(x) and (np.abs(index.values) < np.repeat(index.impact, index.end - index.begin)).all()
    for j in [5, *range(0, 3000, 300)]:
        scores = x @ x[j]
        order = [b for b in np.lexsort((ids, -scores)) if ids[b] != ids[j]]
        want = [(int(scores[b]), int(ids[b])) for b in order[:5]]
        assert index.search(int(ids[j]), x[j], 5, topk.NONE) == want
        assert index.search(int(ids[j]), x[j], 5, want[2][0]) == [w for w in want if w[0] >= want[2][0]]
        assert index.search(int(ids[j]), x[j], 5, 10**9) == []


@pytest.mark.parametrize("block, queries", [(8192, 512), (64, 3)])
def test_top_k(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = np.random.default_rng(1)
    vectors = [(int(k), [float(x) for x in rng.normal(0, 0.1, 8)]) for k in range(600)]
    vectors += [(700 + k, vectors[3][1]) for k in range(8)] + [(800, None), (801, [1.0, None] + [0.0] * 6), (802, [float("nan")] * 8), (803, [float("inf")] * 8), (None, vectors[0][1]), (804, [0.0] * 8), (805, [0.25])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"), F.lit(1).alias("block"))
    got = defaultdict(dict)
    for r in topk.top_k(df, df.where("id % 50 = 0"), 5).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    known = {k: [math.floor(256 * x) for x in v] + [0] * (8 - len(v)) for k, v in vectors if k is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (k for k in known if k % 50 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(known[q], v, strict=True)), k) for k, v in known.items() if k != q))[:5]
        assert got.pop(q) == {n: (k, -s) for n, (s, k) in enumerate(scores, 1)}
    assert not got
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("id < 3")
    assert topk.top_k(few, few, 5).count() == 6


# --- op3 -----------------------------------------------------------------------------------------
def test_chat(spark):
    turns = [(1, 0, "user", "hi\n"), (1, 1, "assistant", "a\\b#</turn>\n### user: x"), (1, 2, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", "é𝔘"), (3, 0, "we:ird\\: ### ", "only"), (None, None, None, None), (4, 1, "assistant", "late"), (4, None, "user", "first"), (5, 0, "system", "s" * 50_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "ts": F.lit("x"), "example": F.lit(2)})
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(df)).collect()}
    wanted = defaultdict(list)
    for c, n, role, said in turns:
        wanted[c].append((-1 if n is None else n, role or "", said or ""))
    assert got.keys() == wanted.keys()
    for c, ts in wanted.items():
        ts.sort()
        loss = "".join(x for _, role, x in ts if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digest(chat.format_chats(df.limit(0))).count() == 0


# --- op4, op8: encodings -------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_librarys_ids(name):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(2)
    plain = Tokenizer.from_file(P.path(name))
    texts = [t or "" for t in odd_texts()] + ["a <|endoftext|>b", "<|endoftext|> c", "d<|endoftext|>\n\n e  ", "\u0301a \u0301"]
    letters = "ab 'll's the  aa\n\r\t\x0bé\u0301日𝔘#12<.,-ßüΣς\xa0ing"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    small = Encoder(P.path(name), 2000)
    small.parts = Parts(500, 2000)
    for e in (Encoder(P.path(name)), Encoder(P.path(name), 2000), small):
        for got, t in zip(e.packed_arrow(pa.array(["left out", *texts])[1:]), texts, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_sstable(spark, docs, none):
    import public_tokenizers as P
    import pyarrow.fs as pafs
    from tokenizers import Tokenizer

    path, name = shared_dir(spark), P.path("word_bpe_49k.json")
    manifest = sstable.write_tables(docs, name, path, file_bytes=1000)
    got = [tuple(r) for r in sstable.read_tables(manifest, path).orderBy("start").collect()]
    plain = Tokenizer.from_file(name)
    want = Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((d, n, c) for d, _, n, c in got) == want
    assert [d for d, *_ in got] == sorted((d for d, *_ in got), key=lambda d: -1 if d is None else d)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    fs, root = pafs.FileSystem.from_uri(path)
    found = []
    for r in manifest.collect():
        with fs.open_input_file(f"{root}/{r.file}") as f:
            reader = sstable.Reader(f, f.size())
            found += reader.get(5)
            assert reader.get(10**9) == []
    assert len(found) == 3
    assert sstable.read_tables(sstable.write_tables(none, name, shared_dir(spark)), path).count() == 0


def test_packing(spark, docs, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    name = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(name)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack_documents(unique, name, 128).collect()
    ids = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in unique.collect()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 128
        padding += 0 if at & (at - 1) == 0 else 128 - at
    assert padding == 0
    assert packing.pack_documents(docs, name).agg(F.sum("length")).first()[0] > 0
    assert packing.pack_documents(none, name).count() == 0


def test_packer_minimises_squares():
    rng, p = random.Random(4), packing.Packer(16)
    for _ in range(300):
        n = rng.randint(1, 15)
        before = p.counts.copy()
        costs = []
        for h in range(0, 17 - n):
            if h and not before[h]:
                continue
            c = before.copy()
            if h:
                c[h] -= 1
            if h + n < 16:
                c[h + n] += 1
            costs.append(int((c**2).sum()))
        p.add((0, n), b"\0" * 4 * n)
        assert int((p.counts**2).sum()) == min(costs)


def test_packer_bounds_its_open_windows():
    rng, p, placed = random.Random(4), packing.Packer(1024, 64), 0
    for k in range(3000):
        n = rng.choice([600, 600, 700, rng.randint(1, 3000)])
        placed += n
        p.add((k, n), np.arange(n, dtype="<u4").tobytes())
        assert p.n_open == sum(map(len, p.open)) == p.counts.sum() <= 64
    p.finish()
    sizes = [sum(len(x[2]) // 4 for x in w) for w in p.closed]
    assert sum(sizes) == placed and all(n == 1024 or n & (n - 1) == 0 for n in sizes) and sum(n < 1024 for n in sizes) <= 10
    pieces = defaultdict(list)
    for w in p.closed:
        for (doc, n), start, ids in w:
            assert np.frombuffer(ids, "<u4")[0] == start
            pieces[doc, n].append((start, len(ids) // 4))
    assert len(pieces) == 3000
    for (_, n), ps in pieces.items():
        assert sorted(ps)[0][0] == 0 and sum(x for _, x in ps) == n and all(a + x == b for (a, x), (b, _) in zip(sorted(ps), sorted(ps)[1:], strict=False))


# --- op5 -----------------------------------------------------------------------------------------
def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def components_by_hand(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (d, _) in enumerate(sets):
        least[root(k)] = min(d, least.get(root(k), d))
    return {(d, len(s), least[root(k)]) for k, (d, s) in enumerate(sets)}


def test_ngram_join(spark, docs, none):
    got = ngram_join.near_duplicates(docs)
    assert got.count() == docs.count() and got.where("doc_id is null and component_id is not null").count() == 0
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    assert {tuple(r) for r in got.where("doc_id is not null").collect()} == components_by_hand(rows)
    assert ngram_join.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot, small", [(64, True), (2, True), (2, False)])
def test_ngram_join_near_copies_and_common_passages(spark, monkeypatch, hot, small):
    """With and without hot signatures, whose rows lie in many parts, and with broadcasts or shuffles alone."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 6)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    if not small:
        monkeypatch.setattr(ngram_join, "if_small", lambda df, rows: df)
    rng = random.Random(8)
    base, line = [f"w{rng.randint(0, 999)}" for _ in range(120)], [f"c{k}" for k in range(30)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(line + [f"u{k}x{j}" for j in range(rng.randint(1, 12))])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in ngram_join.near_duplicates(df).collect()} == components_by_hand(rows)


def test_stored_leaves_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = shuffled()
    table = stored(spark.range(1000).repartition(3, "id"))
    assert not shuffled() - before and table.count() == 1000
    discard(table)
    with pytest.raises(Exception, match="not exist|FileNotFound"):
        table.collect()


def test_signatures_lose_no_link():
    rng = np.random.default_rng(9)
    frequent = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    for _ in range(400):
        n = int(rng.integers(2, 90))
        common = rng.choice(frequent, min(n, int(rng.integers(0, n + 1))), replace=False)
        a = np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)]))
        b = rng.permutation(a)[: len(a) - int(rng.integers(0, len(a) // 6 + 1))]
        b = np.unique(np.concatenate([b, rng.choice(frequent, int(rng.integers(0, len(a) // 8 + 1)), replace=False)]))
        if ngram_join.links(a, b):
            assert np.intersect1d(ngram_join.signatures(a, frequent), ngram_join.signatures(b, frequent)).size
            assert ngram_join.may_link(len(a), ngram_join.parity(a), len(b), ngram_join.parity(b))


# --- op6 -----------------------------------------------------------------------------------------
def test_urls(spark):
    cases = [None, "", "no scheme", "http://Example.ORG/es/x", "https://a.example.org/en/12?x=/es/", "https://example.org", "http://notexample.org/es/", "http://b.com/fr/", "http://com/de/1", "ftp://x.com:80/de/#f", "http://q.net/a?b=2&utm_source=z&a=1#t", "http://www.q.net/a/?a=1&b=2", "x://y.org\n/en/1", "://org/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(cases)] + [(None, cases[3]), (3, cases[3])], "page_id long, url string").withColumns({"rule": F.lit("q"), "key": F.lit(1), "verdict": F.lit("?")})
    rules = spark.createDataFrame(list(urls.RULES), "rule string, verdict string")
    listed = spark.createDataFrame([("https://q.net/a?b=2&a=1",), (None,)], "url string")
    got = urls.judge_urls(pages, rules, listed).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        url = cases[r.page_id] if r.page_id is not None else cases[3]
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]) if m else ("", "")
        fit = [(len(rule), rule, v) for rule, v in urls.RULES if (h := rule.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(rule[len(h) :])]
        want = max(fit, default=(0, None, "block" if url and "q.net/a" in url else "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[1], want[2]), url
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    keys = spark.range(2000).select("id", F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("url"))
    bloom = urls.bloom_filter(keys, 64)
    assert urls.possible_hits(keys, bloom, 64).count() == 2000
    others = spark.range(2000).select(F.concat(F.lit("z"), "id").alias("key"), F.col("id").alias("url"))
    assert urls.possible_hits(others, bloom, 64).count() < 200


@pytest.mark.parametrize("broadcast", [True, False])
def test_long_list_of_urls(spark, monkeypatch, broadcast):
    """100,000 listed URLs, by broadcasts or by joins on block and key; a rule with a host alone."""
    if not broadcast:
        monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 0)
        monkeypatch.setattr(urls, "BROADCAST_KEYS", 0)
    listed = spark.range(100_000).select(F.concat(F.lit("https://www.h"), F.col("id") % 997, F.lit(".net/p/"), "id", F.lit("/")).alias("url"))
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") * 67 % 997, F.lit(".net/p/"), F.col("id") * 67, F.when(F.col("id") % 2 == 0, "?ref=z").otherwise("")).alias("url"))
    rules = spark.createDataFrame([("h5.net", "allow"), ("net/p/134", "allow")], "rule string, verdict string")
    for r in urls.judge_urls(pages, rules, listed).collect():
        host, n = f"h{r.page_id * 67 % 997}.net", r.page_id * 67
        rule = "net/p/134" if str(n).startswith("134") else "h5.net" if host == "h5.net" else None
        assert (r.rule, r.listed, r.verdict) == (rule, n < 100_000, "allow" if rule or n >= 100_000 else "block")


# --- op7 -----------------------------------------------------------------------------------------
def test_token_counts(spark, docs, none):
    import public_tokenizers as P
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    t = transducer.Transducer(transducer.Vocabulary(path), chunk=7, table_entries=1 << 18)
    letters = "ab the  aaaa\n▁é日本𝔘#<s>0123._-ßü \t\xa0東京ing"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(1500)] + [x or "" for x in odd_texts()] + ["the" * 500, " " * 300]
    for group in (5000, 40, 5000):  # smaller ones cut texts at synchronising boundaries
        assert t.counts(texts, group).tolist() == [len(x) for x in sp.encode(texts)]
    got = rows_of(transducer.count_tokens(docs, path, 100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 100) for r in docs.collect()), key=repr)
    assert got == want
    assert transducer.count_tokens(none, path).count() == 0


# --- op9 -----------------------------------------------------------------------------------------
def test_sharding(spark, docs, none):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == docs.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    rng = random.Random(7)
    many = [(k, "copy " * 30 if k % 3 == 0 else text(rng, rng.randint(1, 60))) for k in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(many, "doc_id long, text string").repartition(5), 10).collect()
    slots, sizes, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and slots.keys() == set(range(10))
    assert max(sizes.values()) < 1.03 * min(sizes.values())
    assert sum(len(s) > 1 for s in where.values()) <= 1
    assert sharding.shard_documents(none).count() == 0


def test_sharding_splitters_decide(spark, monkeypatch):
    """Boundaries are quantiles by size; few draws make overfull ranges, which are cut; copies of one id are dealt too."""
    units = spark.range(4000).select(F.xxhash64("id").alias("place"), F.when(F.col("id") % 10 == 0, 500).otherwise(20).alias("bytes"))
    total = units.agg(F.sum("bytes")).first()[0]
    bounds = sorted(r.place for r in sharding.splitters(units, total, 32).collect())
    assert 25 <= len(bounds) <= 31
    held = Counter()
    for r in units.collect():
        held[sum(b <= r.place for b in bounds)] += r.bytes
    assert max(held.values()) < 2.5 * total / 32
    table_, bits = sharding.cells(spark.createDataFrame([(b,) for b in bounds], "place long"), 32)
    rows = {r.cell: (r.below, r.inside) for r in table_.collect()}
    assert len(rows) == 1 << bits
    for r in units.limit(300).collect():
        below, inside = rows[r.place >> (64 - bits)]
        assert below + sum(b <= r.place for b in inside) == sum(b <= r.place for b in bounds)
    monkeypatch.setattr(sharding, "DRAWS", 1)
    copies = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).otherwise("same text of many rows").alias("text"))
    got = sharding.shard_documents(copies.repartition(4), 10, 400).collect()
    assert len(got) == 4000
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 10
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_write_shards(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"), F.lit(3).alias("shard"), F.lit("x").alias("Slot"), F.col("id").alias("key"))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {"doc_id", "text", "shard", "Slot", "key", "_shard"} == set(back.columns)
    assert back.select("_shard").distinct().count() == 4
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))


# --- op10 ----------------------------------------------------------------------------------------
def test_decontamination(spark, docs, none):
    rng = random.Random(11)
    items = [(k, " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 30)}" for _ in range(rng.randint(15, 50)))) for k in range(40)]
    items += [(100, None), (101, ""), (102, "tiny item"), (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit("x"))
    planted = []
    for k, t in items[:40]:
        w = t.split()
        for at in rng.sample(range(len(w)), int(0.15 * len(w))):
            w[at] = rng.choice(WORDS)
        planted.append((1000 + k, text(rng, 400) + " " + " ".join(w).upper() + "! " + text(rng, 200)))
    planted.append((2000, "a Tiny, item here"))
    df = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_contamination(df, benchmark, items_per_pass=15).collect()}
    found = {d - 1000 for d, i in got if d is not None and 1000 <= d < 2000 and i == d - 1000}
    assert len(found) == 40
    assert (2000, 102) in got and not any(d is None or d < 1000 for d, _ in got)
    for (d, i), r in got.items():
        assert r.edit_distance <= 0.2 * r.item_words
        if i is not None and i < 40 and d == 1000 + i:
            words = decontaminate.words_of(dict(planted)[d])
            item = decontaminate.words_of(dict(items[:40])[i])
            assert decontaminate.edit_place(item, words)[0] == r.edit_distance
    assert decontaminate.find_contamination(none, benchmark).count() == 0
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("even", [False, True])
def test_decontamination_full_rate(even):
    """At 0.2 edits a word, random or evenly spaced, what the index finds is what brute force finds."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    items = [(k, [rng.choice(words) for _ in range(6 + k)]) for k in range(59)]
    texts = []
    for _, w in items:
        w = list(w)
        for at in list(range(4, len(w), 5) if even else rng.sample(range(len(w)), len(w) // 5))[: len(w) // 5]:
            w[at] = "other"
        texts.append(rng.choices(words, k=8) + w + rng.choices(words, k=8))
    index = decontaminate.Index([(k, " ".join(w)) for k, w in items])
    got = {(t, i, d) for t, i, _, _, d in index.matches([" ".join(w) for w in texts])}
    near = {(t, i, decontaminate.edit_place(w, x)[0]) for t, x in enumerate(texts) for i, w in items if len(set(w) - set(x)) <= len(w) // 5}
    assert got == {(t, i, d) for t, i, d in near if d <= len(items[i][1]) // 5}
    assert {(t, t) for t in range(59)} <= {(t, i) for t, i, _ in got}


@pytest.mark.parametrize("common", [False, True])
def test_decontamination_recall_by_length(common):
    """Items of 1 to 200 words with all the edits they may have: substitutions, insertions and deletions."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(1500)]
    weights = [1 / (k + 1) for k in range(1500)] if common else None

    def edited(w):
        w = list(w)
        for at in sorted(rng.sample(range(len(w)), len(w) // 5), reverse=True):
            kind = rng.randrange(3)
            w[at : at + 1] = [[rng.choice(words)], [], [w[at], rng.choice(words)]][kind]
        return w

    for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 17, 20, 25, 30, 40, 65, 100, 200):
        count = 200 if n < 65 else 60
        items = [rng.choices(words, weights, k=n) for _ in range(count)]
        texts = [" ".join(rng.choices(words, weights, k=20) + edited(w) + rng.choices(words, weights, k=20)) for w in items]
        index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
        found = {(t, i): d for t, i, _, _, d in index.matches(texts)}
        assert sum((t, t) in found for t in range(count)) >= 0.98 * count, n
        for (t, i), d in list(found.items())[:50]:
            assert d <= n // 5 and d == decontaminate.edit_place(items[i], texts[t].split())[0]


def test_least_edits():
    rng = random.Random(14)
    for _ in range(500):
        item, words = [rng.randint(1, 5) for _ in range(rng.randint(1, 12))], [rng.randint(0, 6) for _ in range(rng.randint(0, 25))]
        masks = {x: sum(1 << k for k, y in enumerate(item) if x == y) for x in set(item)}
        assert decontaminate.least_edits(masks, len(item), words) == decontaminate.edit_place(item, words)[0]
