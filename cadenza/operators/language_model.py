"""N-gram models as tables: (n, context, word, lp, bo) with base-10 logarithms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .networks import reachable
from .storage import Rounds, stored

START, END, UNKNOWN = "<s>", "</s>", "<unk>"
#: The factor from base-10 logarithms to bits.
BITS = 3.321928094887362


def sentences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and words of each text: lower case, split at white space, between sentence marks."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[ \t\n]+"), lambda w: w != "")
    return texts.select(F.col(key), F.concat(F.array(F.lit(START)), words, F.array(F.lit(END))).alias("words"))


def ngrams(sents: DataFrame, key: str, n: int) -> DataFrame:
    """key, place, context (the words before, joined by spaces) and word of each n-gram, sentence start never as word."""
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    rows = sents.where(F.size("words") >= n).select(key, "words", F.explode(starts).alias("place"))
    gram = F.slice("words", F.col("place"), n)
    rows = rows.select(key, "place", F.array_join(F.slice(gram, 1, n - 1), " ").alias("context") if n > 1 else F.lit("").alias("context"), F.element_at(gram, n).alias("word"))
    return rows.where(F.col("word") != START)


def histories(sents: DataFrame, key: str, order: int) -> DataFrame:
    """key, place, context (up to order - 1 words before, joined by spaces) and word of each word but the sentence start."""
    rows = sents.select(key, "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("place"))
    first = F.greatest(F.col("place") - (order - 2), F.lit(1))
    return rows.select(key, "place", F.array_join(F.slice("words", first, F.col("place") - first + 1), " ").alias("context"), F.element_at("words", F.col("place") + 1).alias("word"))


def count_ngrams(sents: DataFrame, key: str, n: int) -> DataFrame:
    return ngrams(sents, key, n).groupBy("context", "word").agg(F.count(F.lit(1)).alias("c"))


def backoff_model(unigrams: DataFrame, bigrams: DataFrame, discount: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Unigrams (word, lp, bo) and bigrams (context, word, lp): absolute discounting of bigrams, the rest for unigrams."""
    # the total is one number
    total = unigrams.agg(F.sum("c")).first()[0] or 1
    uni = unigrams.select("word", F.log10(F.col("c") / F.lit(float(total))).alias("lp"))
    sums = bigrams.groupBy("context").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("kinds"))
    bi = bigrams.join(sums, "context").select("context", "word", F.log10((F.col("c") - discount) / F.col("t")).alias("lp"))
    seen = bigrams.join(uni.select("word", F.pow(F.lit(10.0), F.col("lp")).alias("p")), "word").groupBy("context").agg(F.sum("p").alias("covered"))
    weight = sums.join(seen, "context").select("context", F.log10(F.lit(discount) * F.col("kinds") / F.col("t") / F.greatest(1 - F.col("covered"), F.lit(1e-10))).alias("bo"))
    # a context that is never a word, as the sentence start, has its weight alone
    uni = uni.join(weight.withColumnRenamed("context", "word"), "word", "full").select("word", F.coalesce("lp", F.lit(-99.0)).alias("lp"), F.coalesce("bo", F.lit(0.0)).alias("bo"))
    return uni, bi


def backoff_scores(pairs: DataFrame, uni: DataFrame, bi: DataFrame, unknown: float = -99.0) -> DataFrame:
    """Add lp to (context, word): the bigram if there is one, else the context's back-off weight and the unigram."""
    rows = pairs.join(bi.select("context", "word", F.col("lp").alias("_bi")), ["context", "word"], "left")
    rows = rows.join(uni.select("word", F.col("lp").alias("_uni")), "word", "left")
    rows = rows.join(uni.select(F.col("word").alias("context"), F.col("bo").alias("_bo")), "context", "left")
    lp = F.coalesce("_bi", F.coalesce("_bo", F.lit(0.0)) + F.col("_uni"), F.lit(unknown))
    return rows.withColumn("lp", lp).drop("_bi", "_uni", "_bo")


def interpolated(models: list[tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """keys and lp of a linear interpolation; the weights add up to 1 within 0.01. A model without an entry adds nothing."""
    if abs(sum(c for _, c in models) - 1) > 0.01:
        raise ValueError("interpolation weights must add up to 1")
    parts = None
    for df, c in models:
        part = df.select(*keys, (F.lit(float(c)) * F.pow(F.lit(10.0), F.col("lp"))).alias("p"))
        parts = part if parts is None else parts.union(part)
    return parts.groupBy(*keys).agg(F.log10(F.sum("p")).alias("lp"))


def perplexity(scored: DataFrame, key: str, unknown: float = -99.0) -> DataFrame:
    """key, words, lp, bits (per word), perplexity, n_unknown; unknown words are left out."""
    known = F.col("lp") > unknown
    lp = F.sum(F.when(known, F.col("lp")).otherwise(0.0))
    out = scored.groupBy(key).agg(F.count(F.when(known, 1)).alias("words"), lp.alias("lp"), F.count(F.when(~known, 1)).alias("n_unknown"))
    bits = -F.col("lp") * BITS / F.col("words")
    return out.withColumns({"bits": bits, "perplexity": F.pow(F.lit(10.0), -F.col("lp") / F.col("words"))})


def next_word_table(uni: DataFrame, bi: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, word, lp of all words after each of a stated set of contexts."""
    grid = contexts.select("context").crossJoin(uni.select("word"))
    return backoff_scores(grid, uni, bi)


def sums_to_one(table: DataFrame) -> DataFrame:
    """context and total of the probabilities after it."""
    return table.groupBy("context").agg(F.sum(F.pow(F.lit(10.0), F.col("lp"))).alias("total"))


def lookahead(words: DataFrame, prefix: int) -> DataFrame:
    """node and best: the greatest lp of words (word, lp) below each node, a node being a beginning of up to `prefix` letters."""
    rows = words.select("lp", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("word"), F.lit(prefix))), lambda n: F.col("word").substr(F.lit(1), n))).alias("node"))
    return rows.groupBy("node").agg(F.max("lp").alias("best"))


def with_classes(words: DataFrame, classes: DataFrame, class_lp: DataFrame) -> DataFrame:
    """word and lp from class models: membership (word, class, member) plus the class's lp; words without class keep theirs."""
    rows = words.join(classes, "word", "left").join(class_lp.select("class", F.col("lp").alias("_class")), "class", "left")
    return rows.select("word", F.coalesce(F.col("member") + F.col("_class"), F.col("lp")).alias("lp"))


def vocabulary_union(*vocabularies: DataFrame) -> DataFrame:
    out = vocabularies[0].select("word")
    for v in vocabularies[1:]:
        out = out.union(v.select("word"))
    return out.distinct()


def word_ids(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add id, -1 for words that the vocabulary (word, id) lacks."""
    return words.join(vocabulary, "word", "left").withColumn("id", F.coalesce("id", F.lit(-1)))


def trim_states(arcs: DataFrame, start: Column) -> DataFrame:
    """Arcs (src, dst, final) that lie on a path from the start to a final state."""
    ahead = reachable(arcs, start)
    back = reachable(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "final"), F.col("final"))
    return arcs.join(ahead.withColumnRenamed("node", "src"), "src", "left_semi").join(back.withColumnRenamed("node", "dst"), "dst", "left_semi")


def push_weights(arcs: DataFrame) -> DataFrame:
    """Max-plus pushing: arcs (src, dst, w) get w + potential(dst) - potential(src), a state's potential being its best path to an end.

    Arcs from which no end can be reached go. A cycle of positive weight before an end is an error.
    """
    ends = arcs.select(F.col("dst").alias("s")).join(arcs.select(F.col("src").alias("s")), "s", "left_anti").distinct().withColumn("v", F.lit(0.0))
    values, last, turn = ends, None, 0
    # a best path without a positive cycle has fewer arcs than there are states
    states = arcs.select("src").union(arcs.select("dst")).distinct().count()
    while True:
        step = arcs.join(values, F.col("dst") == F.col("s")).groupBy(F.col("src").alias("s")).agg(F.max(F.col("w") + F.col("v")).alias("v"))
        values = stored(step.union(ends).groupBy("s").agg(F.max("v").alias("v")))
        now = values.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("s", "v"))).first()
        if now == last:
            break
        last, turn = now, turn + 1
        if turn > states:
            raise ValueError("a cycle of positive weight")
    a, b = values.select(F.col("s").alias("src"), F.col("v").alias("_a")), values.select(F.col("s").alias("dst"), F.col("v").alias("_b"))
    return arcs.join(a, "src").join(b, "dst").withColumn("w", F.col("w") + F.col("_b") - F.col("_a")).drop("_a", "_b")


def gram(context: Column, word: Column) -> Column:
    """The words of an n-gram in one string."""
    return F.when(context == "", word).otherwise(F.concat(context, F.lit(" "), word))


def ngram_model(counts: list[DataFrame], discount: float = 0.5, interpolated: bool = False) -> DataFrame:
    """n, context, word, lp, bo of all orders from counts (context, word, c) of orders 1, 2, ...: absolute discounting.

    The weight that a context's n-grams give up goes to its words of the next lower order:
    to those that it lacks (back-off), or to all (`interpolated`, where lp is the n-gram's own share). Counts and
    the model are stored once each, as all orders and most uses read them several times.
    """
    tables = Rounds(counts[0].sparkSession, "ngrams")
    counts = [tables.put(c) for c in counts]
    total = counts[0].agg(F.sum("c")).first()[0] or 1
    grams = counts[0].select(F.lit(1).alias("n"), F.lit("").alias("context"), "word", F.log10(F.col("c") / F.lit(float(total))).alias("lp"))
    out, lower = None, grams
    for n, table in enumerate(counts[1:], 2):
        sums = table.groupBy("context").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("kinds"))
        left = F.lit(discount) * F.col("kinds") / F.col("t")
        if not interpolated:
            shorter = F.regexp_replace("context", r"^\S+ ?", "").alias("context")
            seen = table.select(F.col("context").alias("whole"), shorter, "word").join(lower.select("context", "word", "lp"), ["context", "word"])
            covered = seen.groupBy(F.col("whole").alias("context")).agg(F.sum(F.pow(F.lit(10.0), F.col("lp"))).alias("covered"))
            sums, left = sums.join(covered, "context"), left / F.greatest(1 - F.col("covered"), F.lit(1e-10))
        weights = sums.select(F.col("context").alias("gram"), F.log10(left).alias("bo"))
        # a context that is never a word, as the sentence start, has its weight alone
        held = lower.withColumn("gram", gram(F.col("context"), F.col("word"))).join(weights, "gram", "full")
        word = F.coalesce("word", F.element_at(F.split("gram", " "), -1))
        context = F.coalesce("context", F.regexp_replace("gram", r" ?\S+$", ""))
        part = held.select(F.lit(n - 1).alias("n"), context.alias("context"), word.alias("word"), F.coalesce("lp", F.lit(-99.0)).alias("lp"), F.coalesce("bo", F.lit(0.0)).alias("bo"))
        out = part if out is None else out.union(part)
        lower = table.join(sums, "context").select(F.lit(n).alias("n"), "context", "word", F.log10((F.col("c") - discount) / F.col("t")).alias("lp"))
    last = lower.withColumn("bo", F.lit(0.0))
    return tables.put(last if out is None else out.union(last))


def model_scores(grams: DataFrame, model: DataFrame, order: int, interpolated: bool = False, unknown: float = -99.0, stored: bool = False) -> DataFrame:
    """context, word and lp of distinct (context, word), the context having up to order - 1 words.

    Back-off: the longest n-gram that the model has, plus the weights of the longer contexts.
    Interpolated: from order 1 on, the probability so far times the context's weight, plus the n-gram's
    share; a context that the model lacks changes nothing. All look-ups of a row are one join on the words.
    A `stored` model has the words in its column gram, by which its table is laid out.
    """
    rows = grams.select("context", "word").distinct()
    words = F.filter(F.split("context", " "), lambda w: w != "")
    looks = []
    for n in range(1, order + 1):
        here = F.array_join(F.slice(words, F.greatest(F.size(words) - n + 2, F.lit(1)), n - 1), " ") if n > 1 else F.lit("")
        whole = F.size(words) >= n - 1
        looks.append(F.when(whole, F.struct(F.lit(n).alias("n"), F.lit(True).alias("own"), gram(here, F.col("word")).alias("gram"))))
        if n > 1:
            looks.append(F.when(whole, F.struct(F.lit(n).alias("n"), F.lit(False).alias("own"), here.alias("gram"))))
    spread = rows.select("context", "word", F.explode(F.filter(F.array(*looks), lambda s: s.isNotNull())).alias("s")).select("context", "word", "s.*")
    # a stored model is merged where it lies, whatever its size is thought to be
    table = model.select("gram", "lp", "bo").hint("merge") if stored else model.select(gram(F.col("context"), F.col("word")).alias("gram"), "lp", "bo")
    found = spread.join(table, "gram", "left")
    value = F.when(F.col("own"), F.when(F.col("lp") > unknown, F.col("lp"))).otherwise(F.col("bo"))
    per = found.groupBy("context", "word").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n") * 2 + F.col("own").cast("int"), value))).alias("m"))
    at = lambda n, own: F.try_element_at("m", F.lit(2 * n + own))
    if interpolated:
        p = F.coalesce(F.pow(F.lit(10.0), at(1, 1)), F.lit(0.0))
        for n in range(2, order + 1):
            p = F.when(at(n, 0).isNull(), p).otherwise(p * F.pow(F.lit(10.0), at(n, 0)) + F.coalesce(F.pow(F.lit(10.0), at(n, 1)), F.lit(0.0)))
        return per.select("context", "word", F.when(p > 0, F.log10(p)).otherwise(F.lit(unknown)).alias("lp"))
    lp = at(1, 1)
    for n in range(2, order + 1):
        lp = F.coalesce(at(n, 1), F.coalesce(at(n, 0), F.lit(0.0)) + lp)
    return per.select("context", "word", F.coalesce(lp, F.lit(unknown)).alias("lp"))


def to_backoff(model: DataFrame, order: int) -> DataFrame:
    """An interpolated model as a back-off model: each n-gram's lp becomes its interpolated probability, at most 1; weights stay."""
    lp = model_scores(model, model, order, interpolated=True).withColumn("lp", F.least("lp", F.lit(0.0)))
    return model.drop("lp").join(lp, ["context", "word"]).select("n", "context", "word", "lp", "bo")


def extensions(model: DataFrame) -> DataFrame:
    """context, n and words: of each context of a model the words that it has n-grams for, best first, as (word, lp)."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("lp")).alias("neg"), "word")))
    return model.groupBy("n", "context").agg(F.transform(rows, lambda s: F.struct(s["word"].alias("word"), (-s["neg"]).alias("lp"))).alias("words"))


def probability_sums(model: DataFrame, n: int) -> DataFrame:
    """context and total of the probabilities of all words after each context of order n that has n-grams: those that it
    has, and by its weight what the next lower order has for the others."""
    own = model.where((F.col("n") == n) & (F.col("lp") > -99)).select("context", "word", F.pow(F.lit(10.0), F.col("lp")).alias("p"))
    shorter = F.regexp_replace("context", r"^\S+ ?", "")
    lower = model.where((F.col("n") == n - 1) & (F.col("lp") > -99)).select(F.col("context").alias("short"), "word", F.pow(F.lit(10.0), F.col("lp")).alias("q"))
    seen = own.withColumn("short", shorter).join(lower, ["short", "word"], "left").groupBy("context").agg(F.sum("p").alias("p"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("q"))
    rest = lower.groupBy("short").agg(F.sum("q").alias("whole")) if n == 2 else None
    if rest is None:
        below = probability_sums(model, n - 1)
        rest = below.select(F.col("context").alias("short"), F.col("total").alias("whole"))
    weights = model.where(F.col("n") == n - 1).select(gram(F.col("context"), F.col("word")).alias("context"), F.pow(F.lit(10.0), F.col("bo")).alias("w"))
    rows = seen.withColumn("short", shorter).join(rest, "short", "left").join(weights, "context", "left")
    return rows.select("context", (F.col("p") + F.coalesce("w", F.lit(1.0)) * (F.coalesce("whole", F.lit(1.0)) - F.col("q"))).alias("total"))


def history_lookahead(words: DataFrame, pairs: DataFrame, weights: DataFrame, prefix: int) -> DataFrame:
    """context, node and best: the greatest score of a word below a node after each context that has a pair there.

    `words` (word, lp) are unigrams, `pairs` (context, word, lp) bigrams, `weights` (context, bo). Of words without a pair
    the best one counts, with the context's weight: it is the first place in the node's order that no pair holds.
    """
    nodes = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("word"), F.lit(prefix))), lambda n: F.col("word").substr(F.lit(1), n))).alias("node")
    below = words.select("word", "lp", nodes)
    ranked = below.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("lp"), "word")))
    seen = pairs.select("context", "word", F.col("lp").alias("pair")).join(ranked.select("word", "node", "place"), "word")
    per = seen.groupBy("context", "node").agg(F.max("pair").alias("pair"), F.array_sort(F.collect_list("place")).alias("held"))
    gap = F.filter(F.transform("held", lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i"))), lambda s: s["p"] != s["i"])
    per = per.withColumn("place", F.coalesce(F.get(gap, F.lit(0))["i"], F.size("held") + 1))
    free = ranked.select("node", "place", "lp")
    rows = per.join(free, ["node", "place"], "left").join(weights, "context", "left")
    return rows.select("context", "node", F.greatest("pair", F.coalesce("bo", F.lit(0.0)) + F.col("lp")).alias("best"))


def automaton_text(model: DataFrame, backoff: str = "<B>") -> DataFrame:
    """src, dst, symbol and score: a back-off model as arcs between contexts, which are words in strings.

    An n-gram leads from its context to the longest context that ends it and that the model has; a context's
    weight leads to the context without its first word. Scores are natural logarithms, negated.
    """
    contexts = model.where("context <> ''").select("context").distinct()
    longest = model.withColumn("_g", gram(F.col("context"), F.col("word"))).where(F.col("lp") > -99)
    ends = longest.select("context", "word", "lp", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("_g", " "))), lambda i: F.array_join(F.slice(F.split("_g", " "), i, F.size(F.split("_g", " "))), " "))).alias("cut", "dst"))
    known = ends.join(contexts.select(F.col("context").alias("dst")), "dst")
    best = known.groupBy("context", "word").agg(F.min_by("dst", "cut").alias("dst"))
    ln10 = F.log(F.lit(10.0))
    arcs = longest.join(best, ["context", "word"], "left").select(F.col("context").alias("src"), F.coalesce("dst", F.lit("")).alias("dst"), F.col("word").alias("symbol"), (-F.col("lp") * ln10).alias("score"))
    held = model.withColumn("src", gram(F.col("context"), F.col("word"))).join(contexts.select(F.col("context").alias("src")), "src")
    back = held.select("src", F.regexp_replace("src", r"^\S+ ?", "").alias("dst"), F.lit(backoff).alias("symbol"), (-F.col("bo") * ln10).alias("score"))
    return arcs.union(back)


def walk_automaton(arcs: DataFrame, sentences: DataFrame, key: str, backoff: str = "<B>", start: str = START) -> DataFrame:
    """key and score of each sentence's way through arcs of `automaton_text`: one that its node lacks is looked for behind
    the node's back-off arc. All sentences go on together, a join per word or back-off; one that gets stuck goes."""
    forward = arcs.where(F.col("symbol") != backoff).select(F.col("src").alias("at"), "symbol", F.col("dst").alias("to"), F.col("score").alias("more"))
    back = arcs.where(F.col("symbol") == backoff).select(F.col("src").alias("at"), F.col("dst").alias("back"), F.col("score").alias("fall"))
    tokens = stored(sentences.select(key, F.col("words").alias("left"), F.lit(start).alias("at"), F.lit(0.0).alias("score")))
    done = None
    while True:
        ended = tokens.where(F.size("left") == 0).select(key, "score")
        done = ended if done is None else stored(done.union(ended))
        tokens = tokens.where(F.size("left") > 0)
        if tokens.isEmpty():
            return done
        rows = tokens.withColumn("symbol", F.element_at("left", 1)).join(forward, ["at", "symbol"], "left").join(back, "at", "left")
        moved = F.col("to").isNotNull()
        rows = rows.where(moved | F.col("back").isNotNull())
        left = F.when(moved, F.slice("left", 2, F.greatest(F.size("left") - 1, F.lit(1)))).otherwise(F.col("left"))
        tokens = stored(rows.select(key, left.alias("left"), F.coalesce("to", "back").alias("at"), (F.col("score") + F.coalesce("more", "fall")).alias("score")))


class NgramStore:
    """A model kept as a table in buckets of its n-grams, sorted within, for look-ups that do not move the model.

    The n-grams and contexts that are looked up are shuffled to the buckets; the table is read where it is. So
    a look-up costs what is asked, however large the model is, and tasks hold no model.
    """

    def __init__(self, spark: SparkSession, table: str) -> None:
        self.spark, self.table = spark, table

    @classmethod
    def write(cls, model: DataFrame, table: str, buckets: int = 200) -> NgramStore:
        """Keep a model (n, context, word, lp, bo) under the name of a table, in place of what it held."""
        rows = model.select("n", "context", "word", gram(F.col("context"), F.col("word")).alias("gram"), "lp", "bo")
        rows.repartition(buckets, "gram").write.mode("overwrite").bucketBy(buckets, "gram").sortBy("gram").saveAsTable(table)
        return cls(model.sparkSession, table)

    def model(self) -> DataFrame:
        return self.spark.table(self.table)

    def order(self) -> int:
        return self.model().agg(F.max("n")).first()[0]

    def scores(self, grams: DataFrame, interpolated: bool = False, unknown: float = -99.0) -> DataFrame:
        """As `model_scores`, of distinct (context, word)."""
        return model_scores(grams, self.model(), self.order(), interpolated, unknown, stored=True)
