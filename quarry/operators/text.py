"""Corpus operators: counts, weights, models of words and characters, search, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import char_ngrams, huffman_codes, sentences, word_tokens
from quarry.operators.relational import broadcast_if_small
from quarry.session import cut_lineage


def spread_out(docs: DataFrame) -> DataFrame:
    """``docs`` dealt evenly to all cores where its files give fewer splits than cores; work on words costs more than that shuffle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() <= cores else docs


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bag of words: key, term, tf."""
    return spread_out(docs.select(key, text)).select(key, F.explode(word_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def top_terms(docs: DataFrame, group: str, n: int, text: str = "text") -> DataFrame:
    """The ``n`` most frequent terms of each group, ties by term."""
    counts = spread_out(docs.select(group, text)).select(group, F.explode(word_tokens(F.col(text))).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank.cast("int")).where(F.col("rank") <= n)


def tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text", max_df: float = 1.0) -> DataFrame:
    """key, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 in each document."""
    tf = cut_lineage(term_counts(docs, key, text))  # read twice: for document frequencies and for weights
    n = docs.agg(F.count(F.lit(1)).alias("docs"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") <= max_df * F.col("docs"))
    idf = df.select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(broadcast_if_small(idf), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def exploded_ngrams(docs: DataFrame, n: int, keep: list[str] = (), text: str = "text", sep: str = " ") -> DataFrame:
    """A row for each run of ``n`` neighbouring words: columns w0, w1 and so on, words as they are, without joining them."""
    size = F.greatest(F.size("_w") - n + 1, F.lit(0))
    words = spread_out(docs.select(*keep, text)).select(*keep, F.split(text, sep).alias("_w"))
    zipped = F.arrays_zip(*[F.slice("_w", k + 1, size).alias(f"w{k}") for k in range(n)])
    return words.select(*keep, F.explode(zipped).alias("_g")).select(*keep, *[F.col(f"_g.w{k}").alias(f"w{k}") for k in range(n)])


def ngram_counts(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """w0 to w<n-1> and n: how often each run of ``n`` words occurs."""
    return exploded_ngrams(docs, n, text=text).groupBy(*[f"w{k}" for k in range(n)]).agg(F.count(F.lit(1)).alias("n"))


def markov_counts(docs: DataFrame, n: int, text: str = "text", unit: str = "word") -> DataFrame:
    """How often ``next`` follows each context of ``n`` words or characters."""
    if unit == "word":
        grams = ngram_counts(docs, n + 1, text)
        return grams.select(F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("context"), F.col(f"w{n}").alias("next"), "n")
    counts = docs.select(F.explode(char_ngrams(F.col(text), n + 1)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.substring("g", 1, n).alias("context"), F.expr("substring(g, %d, 1)" % (n + 1)).alias("next"), "n")


def sentence_log_probability(model: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Bigram log-probability of each ``key`` of ``pairs`` (key, context, next).

    A word not seen after its context counts 1 / (total + 1); contexts never seen are passed over.
    """
    model = cut_lineage(model)
    totals = model.groupBy("context").agg(F.sum("n").alias("total"))
    known = model.join(totals, "context").select("context", "next", F.log(F.col("n") / F.col("total")).alias("log_n"))
    counted = pairs.groupBy(key, "context", "next").agg(F.count(F.lit(1)).alias("times"))
    found = cut_lineage(counted.join(known, ["context", "next"], "left"))
    seen = found.where("log_n is not null").select(key, (F.col("times") * F.col("log_n")).alias("log_p"))
    unseen = found.where("log_n is null").join(totals, "context").select(key, (F.col("times") * F.log(1 / (F.col("total") + 1))).alias("log_p"))
    return seen.union(unseen).groupBy(key).agg(F.sum("log_p").alias("log_p"))


def conditional_entropy(docs: DataFrame, rank: int, text: str = "text") -> DataFrame:
    """H of n-grams of ``rank`` + 1 characters less H of those of ``rank``, shares taken of all characters: one row."""
    total = docs.agg(F.sum(F.length(text)).cast("double").alias("chars"))

    def entropy(n: int) -> DataFrame:
        grams = docs.select(F.explode(char_ngrams(F.col(text), n)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        p = F.col("n") / F.col("chars")
        return grams.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(-p * F.log2(p)), F.lit(0.0)).alias(f"h{n}"))

    if rank == 0:
        return entropy(1).select(F.col("h1").alias("entropy"))
    return entropy(rank + 1).crossJoin(entropy(rank)).select((F.col(f"h{rank + 1}") - F.col(f"h{rank}")).alias("entropy"))


def dictionary_hits(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, n: terms of a dictionary in each document, by an equi-join on tokens."""
    tokens = docs.select(key, F.explode(word_tokens(F.col(text))).alias("term"))
    return tokens.join(broadcast_if_small(terms.select("term").distinct()), "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def nearest_words(words: DataFrame, vocabulary: DataFrame, most: int = 2, every: bool = False) -> DataFrame:
    """word, nearest, distance: the vocabulary's word of least edit distance up to ``most``, ties by word.

    Words share a deletion neighbourhood with all words within the distance, so an equi-join on it finds
    the candidates; no pair of all words is made. With ``every``, words that have none so near are then
    compared to the whole vocabulary, so each word gets its nearest at any distance.
    """

    def neighbours(df: DataFrame, name: str) -> DataFrame:
        out = df.select(F.col("word").alias(name)).distinct().withColumn("d", F.array(name))
        for _ in range(most):
            cut = F.flatten(F.transform("d", lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.length(w) - 1, F.lit(0))), lambda i: F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w))))))
            out = out.withColumn("d", F.array_distinct(F.concat("d", cut)))
        return out.select(name, F.explode("d").alias("d"))

    pairs = neighbours(words, "word").join(neighbours(vocabulary, "nearest"), "d").select("word", "nearest").distinct()
    close = pairs.withColumn("distance", F.levenshtein("word", "nearest")).where(F.col("distance") <= most)
    least = lambda df: df.groupBy("word").agg(F.min(F.struct("distance", "nearest")).alias("m")).select("word", "m.nearest", "m.distance")
    if not every:
        return least(close)
    found = cut_lineage(least(close))
    left = cut_lineage(words.select("word").where("word is not null").distinct().join(found, "word", "left_anti"))
    if left.isEmpty():
        return found
    pairs = vocabulary.select(F.col("word").alias("nearest")).where("nearest is not null").distinct().crossJoin(broadcast_if_small(left))
    return found.unionByName(least(pairs.withColumn("distance", F.levenshtein("word", "nearest"))))


def summaries(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", stop_words: list[str] = ()) -> DataFrame:
    """The ``n`` sentences of each document whose words are the most frequent in it: key, position, score, sentence, rank.

    A sentence's score is the sum of its words' counts in the document, stop words apart; rank 1 has the
    least score of those kept, so ranks ascend to the best. Documents don't meet: all is done by their key.
    """
    parts = cut_lineage(docs.select(key, F.posexplode(sentences(F.col(text))).alias("position", "sentence")))
    words = parts.select(key, "position", F.explode(word_tokens(F.col("sentence"))).alias("term")).where(~F.col("term").isin(*stop_words))
    tf = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    score = words.join(tf, [key, "term"]).groupBy(key, "position").agg(F.sum("tf").alias("score"))
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "position"))
    kept = score.withColumn("_best", best).where(F.col("_best") <= n)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_best"))).cast("int")
    return kept.withColumn("rank", rank).drop("_best").join(parts, [key, "position"])


def huffman_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """char, n, code of each character's Huffman code; the tree is built from the counts of characters alone."""
    counts = docs.select(F.explode(F.split(text, "")).alias("char")).where("char != ''").groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    codes = huffman_codes({r["char"]: r["n"] for r in counts.collect()})  # one row for each distinct character
    table = docs.sparkSession.createDataFrame(list(codes.items()) or [("", "")], "char string, code string")
    return counts.join(F.broadcast(table), "char")


def term_counts_by(docs: DataFrame, tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bag of words by a tokenizer of one's own, a function from a text column to an array column: key, term, tf."""
    return docs.select(key, F.explode(tokenizer(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def matrix_facts(tf: DataFrame, key: str = "doc_id") -> DataFrame:
    """documents, terms, nonzero cells, tokens and sparsity of a bag of words (key, term, tf): one row."""
    one = tf.agg(F.count_distinct(key).alias("documents"), F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("nonzero"), F.sum("tf").alias("tokens"))
    return one.withColumn("sparsity", 1 - F.try_divide(F.col("nonzero"), F.col("documents").cast("double") * F.col("terms")))


def vocabulary(tf: DataFrame, documents: int, max_features: int | None = None, max_df: float = 1.0, min_df: int = 1, key: str = "doc_id") -> DataFrame:
    """term, df and n of terms in at least ``min_df`` documents and at most a share ``max_df``; of these the ``max_features`` most frequent, ties by term."""
    terms = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * documents))
    return terms if max_features is None else terms.orderBy(F.desc("n"), "term").limit(max_features)


def bounded_sentences(docs: DataFrame, n: int, keep: list[str] = (), text: str = "text", begin: str = "<BOS>", end: str = "<EOS>") -> DataFrame:
    """n-grams of words between marks of begin and end: columns w0, w1 and so on."""
    marked = F.concat_ws(" ", F.lit(begin), F.col(text), F.lit(end))
    return exploded_ngrams(docs.withColumn(text, marked), n, keep, text)


def generated(counts: DataFrame, start: str, length: int) -> DataFrame:
    """Text that a character model makes: from ``start``, always the most frequent next character, ties by character.

    ``counts``: context, next, n. Only the best next character of each context is kept; text, one row.
    """
    spark = counts.sparkSession
    best = counts.groupBy("context").agg(F.min_by("next", F.struct((-F.col("n")).alias("n"), F.col("next"))).alias("next"))
    cut_lineage(best).createOrReplaceTempView("_best_next")
    size = len(start)
    return spark.sql(
        f"""WITH RECURSIVE made (text, k) MAX RECURSION LEVEL {length + 1} AS (
            SELECT '{start}', 0 UNION ALL SELECT concat(m.text, b.next), m.k + 1 FROM made m JOIN _best_next b ON b.context = right(m.text, {size}) WHERE m.k < {length}
        ) SELECT max_by(text, k) AS text FROM made"""
    )


def indicators(docs: DataFrame, label: str, n: int, top: int, text: str = "text") -> DataFrame:
    """label, gram, lift and rank: the character n-grams whose share among a label's is most above their share among all."""
    grams = docs.select(label, F.explode(char_ngrams(F.lower(text), n)).alias("gram")).groupBy(label, "gram").agg(F.count(F.lit(1)).alias("c"))
    grams = cut_lineage(grams)
    totals = grams.groupBy(label).agg(F.sum("c").alias("t"))
    overall = grams.groupBy("gram").agg(F.sum("c").alias("g"))
    all_ = grams.agg(F.sum("c").alias("a"))
    joined = grams.join(broadcast_if_small(totals), label).join(broadcast_if_small(overall), "gram").crossJoin(F.broadcast(all_))  # one row
    lift = F.col("c") / F.col("t") - F.col("g") / F.col("a")
    rank = F.row_number().over(W.partitionBy(label).orderBy(F.desc("lift"), "gram"))
    return joined.select(label, "gram", lift.alias("lift")).withColumn("rank", rank.cast("int")).where(F.col("rank") <= top)


def mean_word_vectors(docs: DataFrame, vectors: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, vector and words: the mean of the vectors (word, vector) of a document's words that have one, each as often as it occurs."""
    counts = term_counts(docs, key, text).withColumnRenamed("term", "word")
    parts = counts.join(broadcast_if_small(vectors), "word").select(key, "tf", F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy(key, "i").agg((F.sum(F.col("tf") * F.col("x").cast("double")) / F.sum("tf")).alias("x"), F.sum("tf").alias("words"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"), F.max("words").alias("words"))


def huffman_totals(docs: DataFrame, text: str = "text") -> DataFrame:
    """symbols, characters, bits of the text by its Huffman code and by one of fixed length: one row."""
    coded = huffman_size(docs, text)
    one = coded.agg(F.count(F.lit(1)).alias("symbols"), F.sum("n").alias("characters"), F.sum(F.col("n") * F.length("code")).alias("bits"))
    return one.withColumn("fixed_bits", (F.col("characters") * F.greatest(F.lit(1), F.ceil(F.log2("symbols")))).cast("long"))
