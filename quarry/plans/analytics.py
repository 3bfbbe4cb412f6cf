"""Queries over frames, documents, vectors, baskets, statistics and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import frame as E
from quarry.operators import mining as M
from quarry.operators import relational as R
from quarry.operators import stats as S
from quarry.operators import text as T
from quarry.operators import vector as V
from quarry.plans.registry import Tables, query, rounded
from quarry.sources import sinks
from quarry.sources.tables import html_text
from quarry.streaming import windows as ST



# --- frames --------------------------------------------------------------------------------------
@query("describe", "SELECT 'c_acctbal' AS \"column\", count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(median(c_acctbal), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q75, max(c_acctbal) AS max FROM customer")
def describe(t: Tables):
    d = E.describe(t.customer, ["c_acctbal"])
    return d.select("column", "n", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")])


@query("null_profile", "WITH h AS (SELECT nullif(c_mktsegment, 'BUILDING') AS s, CASE WHEN c_nationkey <= 20 THEN c_nationkey END AS k FROM customer) SELECT 's' AS \"column\", count(*) - count(s) AS nulls, count(DISTINCT s) AS distinct_values FROM h UNION ALL SELECT 'k', count(*) - count(k), count(DISTINCT k) FROM h")
def null_profile(t: Tables):
    return E.null_profile(t.customer.select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"), F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("k")), ["s", "k"])


@query("value_counts_norm", "SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def value_counts_norm(t: Tables):
    return E.value_counts(t.orders, "o_orderpriority").withColumn("share", rounded(F.col("share")))


@query("crosstab", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def crosstab(t: Tables):
    return E.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("get_dummies", "SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INTEGER) AS \"o_orderstatus_P\" FROM orders")
def get_dummies(t: Tables):
    return E.dummies(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], drop_first=True)


@query("row_idxmax", "SELECT l_orderkey, l_linenumber, CASE greatest(l_quantity, l_discount * 300, l_tax * 300) WHEN l_quantity THEN 'l_quantity' WHEN l_discount * 300 THEN 'd' ELSE 't' END AS best FROM lineitem")
def row_idxmax(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 300).alias("d"), (F.col("l_tax") * 300).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", E.row_idxmax(["l_quantity", "d", "t"]).alias("best"))


@query("minmax_scale", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS scaled FROM customer")
def minmax_scale(t: Tables):
    return E.scaled(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "scaled").select("c_custkey", rounded(F.col("scaled")).alias("scaled"))


@query("zscore", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z FROM customer")
def zscore(t: Tables):
    return E.scaled(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "z", "zscore").select("c_custkey", rounded(F.col("z")).alias("z"))


@query("iqr_outliers", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value < a - 2 * (b - a) OR value > b + 2 * (b - a)")
def iqr_outliers(t: Tables):
    return E.iqr_outliers(t.events.select("event_id", "value"), "value")


@query("sigma_outliers", "SELECT event_id, value FROM events WHERE abs(value - (SELECT avg(value) FROM events)) > 3 * (SELECT stddev_samp(value) FROM events)")
def sigma_outliers(t: Tables):
    return E.sigma_outliers(t.events.select("event_id", "value"), "value")


@query("corr_matrix", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def corr_matrix(t: Tables):
    return E.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", rounded(F.col("r")))


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(1 - 6 * sum((a - b) * (a - b))::DOUBLE / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*)::DOUBLE - 1)), 6) AS rho FROM r")
def spearman(t: Tables):
    return S.spearman(t.part, "p_size", "p_retailprice").select(rounded(F.col("rho")).alias("rho"))


@query("histogram", "SELECT CAST(CASE WHEN value = 100 THEN 9 WHEN value < 0 THEN -1 ELSE least(floor(value * 10 / 100), 10) END AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(t: Tables):
    return E.histogram(t.events, "value", 0.0, 100.0, 10)


@query("fill_median", "SELECT c_custkey, round(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, (SELECT median(c_acctbal) FROM customer WHERE c_acctbal >= 0)), 4) AS c_acctbal FROM customer")
def fill_median(t: Tables):
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    return E.filled(rows, "c_acctbal").select("c_custkey", rounded(F.col("c_acctbal"), 4).alias("c_acctbal"))


# --- documents and nested rows -------------------------------------------------------------------
@query("props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("unwind_avg", "SELECT l_returnflag, round(avg(l_quantity), 6) AS m FROM lineitem GROUP BY 1 ORDER BY 2 DESC LIMIT 1")
def unwind_avg(t: Tables):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("lines"))
    flat = nested.select(F.explode("lines").alias("l")).groupBy("l.l_returnflag").agg(F.avg("l.l_quantity").alias("m"))
    return flat.orderBy(F.desc("m")).limit(1).withColumn("m", rounded(F.col("m")))


@query("array_push_pull", "SELECT l_orderkey, array_to_string(list_sort(list_append(list_filter(list(l_linenumber), lambda x: x <> 2), 99)), ',') AS lines, CAST(list_contains(list(l_linenumber), 3) AS BOOLEAN) AS has_three FROM lineitem GROUP BY 1")
def array_push_pull(t: Tables):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"))
    changed = F.sort_array(F.array_append(F.filter("a", lambda x: x != 2), F.lit(99)))
    return lists.select("l_orderkey", F.array_join(F.transform(changed, lambda x: x.cast("string")), ",").alias("lines"), F.exists("a", lambda x: x == 3).alias("has_three"))


@query("rollup_tree", "WITH f AS (SELECT n_regionkey AS b, n_nationkey AS fl, sum(c_acctbal + 1000) AS area, sum(c_custkey + 1) AS vol, sum(c_custkey % 7) / sum(c_acctbal + 1000) AS light, sum(c_custkey % 11)::DOUBLE / sum(c_custkey + 1) AS en FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT b AS building, round(sum(area), 2) AS area, CAST(sum(vol) AS BIGINT) AS volume, round(avg(light), 8) AS light, round(avg(en), 8) AS energy FROM f GROUP BY 1")
def rollup_tree(t: Tables):
    rooms = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("building"), F.col("n_nationkey").alias("floor"), (F.col("c_acctbal") + 1000).alias("a"), (F.col("c_custkey") + 1).alias("v"), (F.col("c_custkey") % 7).alias("l"), (F.col("c_custkey") % 11).alias("e"))
    out = S.roll_up_tree(rooms, "building", "floor", "a", "v", "l", "e")
    return out.select("building", rounded(F.col("area"), 2).alias("area"), F.col("volume").cast("long").alias("volume"), rounded(F.col("light"), 8).alias("light"), rounded(F.col("energy"), 8).alias("energy"))


@query("nested_details", "SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n, string_agg(l_linenumber || ':' || CAST(l_quantity AS INTEGER), ',' ORDER BY l_linenumber, l_quantity) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_details(t: Tables):
    nested = sinks.nested_details(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity"), "o_orderkey", "lines", "l_linenumber")
    return nested.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_quantity"].cast("int").cast("string"))), ",").alias("lines"))


@query("packed_codes", "SELECT o_orderkey, lower(lpad(printf('%x', o_orderkey), 8, '0') || '0000002a') AS packed, o_orderkey + 42 AS total FROM orders")
def packed_codes(t: Tables):
    rows = t.orders.select("o_orderkey", sinks.pack_codes(F.array(F.col("o_orderkey"), F.lit(42).cast("long"))).alias("p"))
    back = sinks.unpack_codes(F.col("p"))
    return rows.select("o_orderkey", F.lower(F.hex("p")).alias("packed"), F.aggregate(back, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


# --- text ----------------------------------------------------------------------------------------
TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


@query("bow_counts", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2")
def bow_counts(t: Tables):
    return T.term_counts(t.documents)


@query("top_terms_by_lang", f"WITH c AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2) SELECT lang, term, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 10")
def top_terms_by_lang(t: Tables):
    return T.top_terms(t.documents, "lang", 10)


@query("tfidf", f"WITH f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2), d AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY 1), w AS (SELECT doc_id, term, tf * idf AS w FROM f JOIN d USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w")
def tfidf(t: Tables):
    return T.tfidf(t.documents).withColumn("weight", rounded(F.col("weight")))


@query("word_ngrams", "WITH w AS (SELECT string_split(text, ' ') AS w FROM documents) SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w) GROUP BY 1")
def word_ngrams(t: Tables):
    return T.ngram_counts(t.documents, 2).select(F.concat_ws(" ", "w0", "w1").alias("g"), "n")


@query("markov_chars", "SELECT g[1:2] AS context, g[3] AS next, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))) AS g FROM documents) GROUP BY 1, 2")
def markov_chars(t: Tables):
    return T.markov_counts(t.documents, 2, unit="char")


@query("sentence_prob", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), p AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) AS g FROM w), m AS (SELECT g.a AS a, g.b AS b, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT a, sum(n) AS total FROM m GROUP BY 1) SELECT doc_id, round(sum(ln(coalesce(n / total, 1 / (total + 1)))), 3) AS log_p FROM p JOIN s ON g.a = s.a LEFT JOIN m ON m.a = g.a AND m.b = g.b GROUP BY 1")
def sentence_prob(t: Tables):
    model = T.markov_counts(t.documents, 1)
    pairs = T.exploded_ngrams(t.documents, 2, ["doc_id"]).toDF("doc_id", "context", "next")
    return T.sentence_log_probability(model, pairs, "doc_id").withColumn("log_p", rounded(F.col("log_p"), 3))


@query("cond_entropy", "WITH t AS (SELECT sum(length(text))::DOUBLE AS n FROM documents), a AS (SELECT count(*) AS c FROM (SELECT unnest(list_transform(range(1, length(text)), lambda i: substring(text, i, 2))) AS g FROM documents) GROUP BY g), b AS (SELECT count(*) AS c FROM (SELECT unnest(list_transform(range(1, length(text) + 1), lambda i: substring(text, i, 1))) AS g FROM documents) GROUP BY g) SELECT round((SELECT sum(-c / n * log2(c / n)) FROM a, t) - (SELECT sum(-c / n * log2(c / n)) FROM b, t), 6) AS entropy")
def cond_entropy(t: Tables):
    return T.conditional_entropy(t.documents, 1).select(rounded(F.col("entropy")).alias("entropy"))


@query("avg_word_len", "SELECT lang, round(avg(length(w)), 6) AS m FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def avg_word_len(t: Tables):
    return t.documents.select("lang", F.explode(F.split("text", " ")).alias("w")).groupBy("lang").agg(rounded(F.avg(F.length("w"))).alias("m"))


@query("html_strip", r"""SELECT page_id, md5(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), 'x^', '')) AS text_md5, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages""")
def html_strip(t: Tables):
    return t.pages.select("page_id", F.md5(html_text(F.col("html"))).alias("text_md5"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query("url_params", r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '[?&]page=(\d+)', 1) AS page, nullif(split_part(url, '#', 2), '') AS fragment FROM pages")
def url_params(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", r"[?&]page=(\d+)", 1).alias("page"), F.nullif(F.split_part("url", F.lit("#"), F.lit(2)), F.lit("")).alias("fragment"))


@query("dict_search", f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) WHERE term IN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) FROM benchmark) GROUP BY 1, 2")
def dict_search(t: Tables):
    return T.dictionary_hits(t.documents, t.benchmark.select(F.explode(X.word_tokens(F.col("text"))).alias("term")))


@query("spell_nearest", "WITH w AS (SELECT DISTINCT lower(p_name) AS word FROM part), v AS (SELECT DISTINCT lower(c_mktsegment) AS word FROM customer UNION SELECT lower(p_name) || 'x' FROM part) SELECT w.word, min_by(v.word, {'d': levenshtein(w.word, v.word), 'v': v.word}) AS nearest, CAST(min(levenshtein(w.word, v.word)) AS INTEGER) AS distance FROM w CROSS JOIN v GROUP BY 1")
def spell_nearest(t: Tables):
    words = t.part.select(F.lower("p_name").alias("word"))
    vocabulary = t.customer.select(F.lower("c_mktsegment").alias("word")).union(t.part.select(F.concat(F.lower("p_name"), F.lit("x"))))
    return T.nearest_words(words, vocabulary, every=True)


@query("chunks", "SELECT doc_id, CAST(i AS INTEGER) AS i, substring(text, i * 800 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, 1 + (greatest(length(text) - 200, 1) - 1) // 800)) AS i FROM documents)")
def chunks(t: Tables):
    return t.documents.select("doc_id", F.posexplode(X.chunks(F.col("text"), 1000, 200)).alias("i", "chunk"))


STOP_WORDS = ("and", "de", "der", "die", "el", "in", "is", "la", "le", "les", "of", "que", "the", "to", "und")


SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


@query("extractive_summary", rf"WITH p AS (SELECT doc_id, {SENTENCES} AS ss FROM documents), q AS (SELECT doc_id, unnest(ss) AS sentence, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS position FROM p), w AS (SELECT doc_id, position, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM q), k AS (SELECT * FROM w WHERE term NOT IN {STOP_WORDS}), f AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY 1, 2), s AS (SELECT doc_id, position, CAST(sum(tf) AS BIGINT) AS score FROM k JOIN f USING (doc_id, term) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS best FROM s) SELECT doc_id, position, score, md5(sentence) AS sentence_md5, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY best DESC) AS INTEGER) AS rank FROM b JOIN q USING (doc_id, position) WHERE best <= 2")
def extractive_summary(t: Tables):
    found = T.summaries(t.documents, 2, stop_words=list(STOP_WORDS))
    return found.select("doc_id", "position", "score", F.md5("sentence").alias("sentence_md5"), "rank")


@query("lzw_round_trip", "SELECT doc_id, md5(text) AS text_md5, octet_length(encode(text)) > 0 AS has_codes FROM documents")
def lzw_round_trip(t: Tables):
    packed = t.documents.select("doc_id", X.lzw_compress("text").alias("codes"))
    return packed.select("doc_id", F.md5(X.lzw_decompress("codes")).alias("text_md5"), (F.size("codes") > 0).alias("has_codes"))


@query("huffman_size")
def huffman_size(t: Tables):
    return T.huffman_size(t.documents)


# --- vectors -------------------------------------------------------------------------------------
@query("mean_embedding_by_label", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def mean_embedding_by_label(t: Tables):
    means = V.mean_vectors(t.embeddings, "label")
    return means.select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", rounded(F.col("x")))


@query("analogy", "WITH t AS (SELECT list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE + c.embedding[i]::DOUBLE) AS t FROM embeddings a, embeddings b, embeddings c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3) SELECT vec_id, round(list_cosine_similarity(t, embedding::DOUBLE[]), 6) AS value FROM embeddings, t WHERE vec_id NOT IN (1, 2, 3) ORDER BY 2 DESC, 1 LIMIT 1")
def analogy(t: Tables):
    return V.analogy(t.embeddings, 1, 2, 3).withColumn("value", rounded(F.col("value")))


@query("cosine_topk", "SELECT query_id, vec_id, value, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS value, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS INTEGER) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def cosine_topk(t: Tables):
    near = V.nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings.select("vec_id", "embedding"), 5)
    return near.select("query_id", "vec_id", rounded(F.col("value")).alias("value"), "rank")


@query("euclid_topk", "SELECT query_id, vec_id, value, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS value, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS INTEGER) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 3")
def euclid_topk(t: Tables):
    near = V.nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings.select("vec_id", "embedding"), 3, "euclidean")
    return near.select("query_id", "vec_id", rounded(F.col("value")).alias("value"), "rank")


@query("knn_vote", "WITH n AS (SELECT q.vec_id AS query_id, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS k FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY k) AS votes FROM n WHERE k <= 7) SELECT query_id, label AS predicted, votes FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, k) = 1")
def knn_vote(t: Tables):
    return V.knn_votes(t.embeddings, t.embeddings, 7)


# --- mining --------------------------------------------------------------------------------------
BASKETS = "(SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def baskets(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item"))


@query("apriori_itemsets", f"WITH b AS {BASKETS}, n AS (SELECT count(DISTINCT basket) AS total FROM b) SELECT item AS items, count(*) AS n, round(count(*) / max(total), 6) AS support FROM b, n GROUP BY 1 HAVING count(*) >= 0.02 * max(total) UNION ALL SELECT x.item || ',' || y.item, count(*), round(count(*) / max(total), 6) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item, n GROUP BY 1 HAVING count(*) >= 0.02 * max(total) UNION ALL SELECT x.item || ',' || y.item || ',' || z.item, count(*), round(count(*) / max(total), 6) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item JOIN b z ON z.basket = y.basket AND y.item < z.item, n GROUP BY 1 HAVING count(*) >= 0.02 * max(total)")
def apriori_itemsets(t: Tables):
    sets = M.frequent_itemsets(baskets(t), 0.02)
    return sets.select(F.array_join("items", ",").alias("items"), "n", rounded(F.col("support")).alias("support"))


@query("rules_metrics", f"WITH b AS {BASKETS}, n AS (SELECT count(DISTINCT basket) AS total FROM b), s AS (SELECT item, count(*) / max(total) AS s FROM b, n GROUP BY 1), p AS (SELECT x.item AS a, y.item AS c, count(*) / max(total) AS s FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item, n GROUP BY 1, 2 HAVING count(*) >= 0.02 * max(total)) SELECT a AS antecedent, c AS consequent, round(p.s, 6) AS support, round(p.s / sa.s, 6) AS confidence, round(p.s / sa.s / sc.s, 6) AS lift, round((1 - sc.s) / (1 - p.s / sa.s), 6) AS conviction FROM p JOIN s sa ON sa.item = a JOIN s sc ON sc.item = c WHERE p.s / sa.s >= 0.1")
def rules_metrics(t: Tables):
    rules = M.association_rules(M.frequent_itemsets(baskets(t), 0.02), 0.1)
    return rules.select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), *[rounded(F.col(c)).alias(c) for c in ("support", "confidence", "lift", "conviction")])


@query("kmeans_step", "WITH c AS (SELECT 0 AS cluster, 0.0::DOUBLE AS x, 10.0::DOUBLE AS y UNION ALL SELECT 1, 5000.0, 25.0 UNION ALL SELECT 2, 1500.0, 40.0), a AS (SELECT p_partkey, p_retailprice AS px, p_size::DOUBLE AS py, min_by(cluster, {'d': pow(p_retailprice - x, 2) + pow(p_size::DOUBLE - y, 2), 'c': cluster}) AS cluster FROM part, c GROUP BY 1, 2, 3) SELECT c.cluster, round(coalesce(m.x, c.x), 6) AS x, round(coalesce(m.y, c.y), 6) AS y FROM c LEFT JOIN (SELECT cluster, avg(px) AS x, avg(py) AS y FROM a GROUP BY 1) m USING (cluster)")
def kmeans_step(t: Tables):
    points = t.part.select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    centres = t.spark.createDataFrame([(0, 0.0, 10.0), (1, 5000.0, 25.0), (2, 1500.0, 40.0)], "cluster int, x double, y double")
    _, moved = M.kmeans_step(points, centres, ["x", "y"], "p_partkey")
    return moved.select("cluster", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query("information_gain", "WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), v AS (SELECT a, sum(n) AS m FROM c GROUP BY 1), h AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(n) / (SELECT sum(n) FROM c) AS p FROM c GROUP BY y)), s AS (SELECT sum(-n / (SELECT sum(n) FROM c) * log2(n / m)) AS s FROM c JOIN v USING (a)), i AS (SELECT -sum(m / (SELECT sum(n) FROM c) * log2(m / (SELECT sum(n) FROM c))) AS i FROM v) SELECT round(h - s, 8) AS gain, round((h - s) / i, 8) AS gain_ratio FROM h, s, i")
def information_gain(t: Tables):
    g = M.information_gain(t.orders, "o_orderstatus", "o_orderpriority")
    return g.select(rounded(F.col("gain"), 8).alias("gain"), rounded(F.col("gain_ratio"), 8).alias("gain_ratio"))


@query("best_split", "WITH v AS (SELECT n_chars AS v, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS ones FROM documents JOIN labels USING (doc_id) GROUP BY 1), s AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(n) OVER (ORDER BY v) AS ln, sum(ones) OVER (ORDER BY v) AS l1, sum(n) OVER () AS tn, sum(ones) OVER () AS t1 FROM v), h AS (SELECT (v + nx) / 2 AS threshold, ln, tn, l1 / ln AS a, (t1 - l1) / (tn - ln) AS b FROM s WHERE nx IS NOT NULL), e AS (SELECT threshold, (ln * (CASE WHEN a > 0 AND a < 1 THEN -a * log2(a) - (1 - a) * log2(1 - a) ELSE 0 END) + (tn - ln) * (CASE WHEN b > 0 AND b < 1 THEN -b * log2(b) - (1 - b) * log2(1 - b) ELSE 0 END)) / tn AS entropy FROM h) SELECT threshold, round(entropy, 8) AS entropy FROM e ORDER BY entropy, threshold LIMIT 1")
def best_split(t: Tables):
    return M.best_split(t.documents.join(t.labels, "doc_id").select("n_chars", "quality"), "n_chars", "quality").withColumn("entropy", rounded(F.col("entropy"), 8))


@query("nb_bernoulli", "SELECT y AS label, round(count(*) / (SELECT count(*) FROM customer), 6) AS prior, round((sum(a) + 1) / (count(*) + 2), 6) AS p_a, round((sum(b) + 1) / (count(*) + 2), 6) AS p_b FROM (SELECT c_mktsegment AS y, CAST(c_acctbal > 0 AS INTEGER) AS a, CAST(c_nationkey < 10 AS INTEGER) AS b FROM customer) GROUP BY 1")
def nb_bernoulli(t: Tables):
    rows = t.customer.select(F.col("c_mktsegment").alias("y"), (F.col("c_acctbal") > 0).cast("int").alias("a"), (F.col("c_nationkey") < 10).cast("int").alias("b"))
    return M.bernoulli_bayes(rows, ["a", "b"], "y").select("label", *[rounded(F.col(c)).alias(c) for c in ("prior", "p_a", "p_b")])


@query("kfold_assign", "SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def kfold_assign(t: Tables):
    return M.stratified_folds(t.labels, "quality", "doc_id", 5).select("doc_id", "fold")


@query("outranking", "WITH s AS (SELECT c_mktsegment AS name, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1), p AS (SELECT a.name AS a, b.name AS b, b.n - a.n AS dn, a.m - b.m AS dm FROM s a JOIN s b ON a.name <> b.name) SELECT a, b, round((2 * CASE WHEN dn <= 5 THEN 1.0 WHEN dn > 30 THEN 0.0 ELSE (30 - dn) / 25.0 END + CASE WHEN dm <= 100 THEN 1.0 WHEN dm > 800 THEN 0.0 ELSE (800 - dm) / 700.0 END) / 3, 8) AS concordance, dn >= 200 OR dm >= 3000 AS vetoed, (2 * CASE WHEN dn <= 5 THEN 1.0 WHEN dn > 30 THEN 0.0 ELSE (30 - dn) / 25.0 END + CASE WHEN dm <= 100 THEN 1.0 WHEN dm > 800 THEN 0.0 ELSE (800 - dm) / 700.0 END) / 3 >= 0.7 AND NOT (dn >= 200 OR dm >= 3000) AS outranks FROM p")
def outranking(t: Tables):
    criteria = {"n": {"gain": True, "weight": 2.0, "q": 5, "p": 30, "v": 200}, "m": {"gain": False, "weight": 1.0, "q": 100.0, "p": 800.0, "v": 3000.0}}
    alternatives = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"))
    return M.outranking(alternatives, criteria, 0.7).withColumn("concordance", rounded(F.col("concordance"), 8))


# --- statistics ----------------------------------------------------------------------------------
@query("ols_simple", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def ols_simple(t: Tables):
    r = S.simple_regression(t.lineitem, "l_extendedprice", "l_quantity")
    return r.select(rounded(F.col("slope")).alias("slope"), rounded(F.col("intercept"), 4).alias("intercept"), rounded(F.col("r2"), 8).alias("r2"))


@query("ols_multi", "WITH c AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_discount, l_discount) AS b, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS byy FROM lineitem) SELECT round((ay * b - byy * ab) / (a * b - ab * ab), 6) AS b1, round((byy * a - ay * ab) / (a * b - ab * ab), 4) AS b2 FROM c")
def ols_multi(t: Tables):
    r = S.two_factor_regression(t.lineitem, "l_extendedprice", "l_quantity", "l_discount")
    return r.select(rounded(F.col("b1")).alias("b1"), rounded(F.col("b2"), 4).alias("b2"))


@query("ttest_pooled", "WITH g AS (SELECT avg(value) FILTER (WHERE event_type = 'click') AS ma, avg(value) FILTER (WHERE event_type = 'view') AS mb, var_samp(value) FILTER (WHERE event_type = 'click') AS va, var_samp(value) FILTER (WHERE event_type = 'view') AS vb, count(*) FILTER (WHERE event_type = 'click') AS na, count(*) FILTER (WHERE event_type = 'view') AS nb FROM events) SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS t, na + nb - 2 AS degrees FROM g")
def ttest_pooled(t: Tables):
    rows = t.events.where("event_type IN ('click', 'view')")
    return S.pooled_t(rows, "value", F.col("event_type") == "click").withColumn("t", rounded(F.col("t")))


@query("anova_f", "WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1) SELECT round(((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM g")
def anova_f(t: Tables):
    return S.anova(t.events, "event_type", "value").withColumn("f", rounded(F.col("f"), 5))


@query("classification_metrics", "WITH r AS (SELECT quality AS a, CAST(n_chars > 500 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT k, sum(CAST(a = k AND p = k AS INTEGER)) AS tp, sum(CAST(a <> k AND p = k AS INTEGER)) AS fp, sum(CAST(a = k AND p <> k AS INTEGER)) AS fn, sum(CAST(a <> k AND p <> k AS INTEGER)) AS tn FROM r, (SELECT unnest([0, 1]) AS k) GROUP BY k), m AS (SELECT tp, fp, fn, tp / (tp + fp + 1e-9) AS pr, tp / (tp + fn + 1e-9) AS re, tn / (tn + fp + 1e-9) AS sp FROM c) SELECT (SELECT round(avg(CAST(a = p AS INTEGER)), 6) FROM r) AS accuracy, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(sp), 6) AS specificity, round(avg(2 * pr * re / (pr + re + 1e-9)), 6) AS f1, round(exp(avg(ln(greatest(re, 1e-9)))), 6) AS g_mean, round(avg((re + sp) / 2), 6) AS balanced_accuracy, round(sum(tp) / (sum(tp) + sum(fp) + 1e-9), 6) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn) + 1e-9), 6) AS micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn) + 1e-9), 6) AS micro_f1 FROM m")
def classification_metrics(t: Tables):
    rows = t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("a"), (F.col("n_chars") > 500).cast("int").alias("p"))
    m = S.classification_metrics(rows, "a", "p")
    return m.select(*[rounded(F.col(c)).alias(c) for c in m.columns])


@query("roc_auc", "WITH r AS (SELECT quality AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM labels JOIN documents USING (doc_id)) SELECT round((sum(k) FILTER (WHERE y = 1)::DOUBLE - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def roc_auc(t: Tables):
    return S.roc_auc(t.labels.join(t.documents, "doc_id"), "quality", "n_chars").select(rounded(F.col("auc")).alias("auc"))


@query("regression_errors", "SELECT round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(avg(pow(l_extendedprice - l_quantity * 1500, 2)), 1) AS mse FROM lineitem")
def regression_errors(t: Tables):
    e = S.regression_errors(t.lineitem.withColumn("guess", F.col("l_quantity") * 1500), "l_extendedprice", "guess")
    return e.select(rounded(F.col("mae"), 4).alias("mae"), rounded(F.col("mse"), 1).alias("mse"))


INFLUENCE = "round(h, 8) AS leverage, round(e / sqrt(s2 * (1 - h)), 6) AS residual, round(pow(e, 2) / (s2 * (1 - h)) / {p} * h / (1 - h), 8) AS cooks_distance, round(e / sqrt((((n - {p}) * s2 - pow(e, 2) / (1 - h)) / (n - {p} - 1)) * (1 - h)) * sqrt(h / (1 - h)), 6) AS dffits"


def influence_digits(df):
    return df.select("p_partkey", *[rounded(F.col(c), d).alias(c) for c, d in (("leverage", 8), ("residual", 6), ("cooks_distance", 8), ("dffits", 6))])


@query("influence", f"WITH f AS (SELECT count(*) AS n, avg(p_size) AS mx, avg(p_retailprice) AS my, var_pop(p_size) * count(*) AS sxx, covar_pop(p_size, p_retailprice) * count(*) AS sxy, var_pop(p_retailprice) * count(*) AS syy FROM part), r AS (SELECT p_partkey, n, (syy - sxy * sxy / sxx) / (n - 2) AS s2, 1 / n + pow(p_size - mx, 2) / sxx AS h, p_retailprice - my - sxy / sxx * (p_size - mx) AS e FROM part, f) SELECT p_partkey, {INFLUENCE.format(p=2)} FROM r")
def influence(t: Tables):
    return influence_digits(S.influence(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", "p_size"))


@query("dft_daily", "WITH d AS (SELECT row_number() OVER (ORDER BY d) - 1 AS t, n, count(*) OVER () AS m FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)) SELECT CAST(k AS INTEGER) AS k, round(sqrt(pow(sum(n * cos(2 * pi() * k * t / m)), 2) + pow(sum(n * sin(2 * pi() * k * t / m)), 2)), 4) AS amplitude FROM d, (SELECT unnest(range(0, (SELECT max(m) FROM d) // 2 + 1)) AS k) GROUP BY 1")
def dft_daily(t: Tables):
    daily = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return S.spectrum(daily, "d", "n").withColumn("amplitude", rounded(F.col("amplitude"), 4))


# --- events --------------------------------------------------------------------------------------
@query("daily_windows", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_windows(t: Tables):
    w = ST.windowed_counts(t.events, "1 day")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", rounded(F.col("total"), 2).alias("total"))


@query("session_gaps", "WITH g AS (SELECT *, CASE WHEN epoch(ts) // 1 - epoch(lag(ts) OVER w) // 1 < 1800 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2")
def session_gaps(t: Tables):
    return ST.sessions_by_gap(t.events, 1800).select("user_id", "session", "n")


@query("enter_leave", "SELECT user_id, event_id FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events WHERE event_type IN ('signup', 'purchase')) WHERE event_type = 'signup' AND nx = 'purchase'")
def enter_leave(t: Tables):
    pairs = ST.enter_leave_pairs(t.events, "signup", "purchase")
    starts = t.events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("entered"), "event_id")
    return pairs.join(starts, ["user_id", "entered"]).select("user_id", "event_id")


@query("alarms", "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 90")
def alarms(t: Tables):
    return ST.alarms(t.events, "error", 90).select("event_id", "value")


@query("lookup_names", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def lookup_names(t: Tables):
    return t.customer.join(R.broadcast_if_small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("gaussian_bayes", "SELECT label, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS prior, round(avg(embedding[1]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[1]::DOUBLE), 6) AS sd FROM embeddings GROUP BY 1")
def gaussian_bayes(t: Tables):
    x = F.col("embedding")[0].cast("double")
    n = t.embeddings.agg(F.count(F.lit(1)).alias("rows"))
    per = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    return per.crossJoin(F.broadcast(n)).select("label", rounded(F.col("n") / F.col("rows")).alias("prior"), rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"))  # a one-row side


@query("cluster_profile", "SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS mean, round(stddev_samp(embedding[1]::DOUBLE), 6) AS sd, round(min(embedding[1]::DOUBLE), 6) AS lo, round(max(embedding[1]::DOUBLE), 6) AS hi FROM embeddings GROUP BY 1")
def cluster_profile(t: Tables):
    x = F.col("embedding")[0].cast("double")
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(x)).alias("mean"), rounded(F.stddev_samp(x)).alias("sd"), rounded(F.min(x)).alias("lo"), rounded(F.max(x)).alias("hi"))


@query("seeded_numbers")
def seeded_numbers(t: Tables):
    return t.spark.range(1000).select("id", F.rand(7).alias("uniform"), F.randn(7).alias("normal"))
