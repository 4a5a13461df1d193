"""N-gram language models as count tables.

The neural models of the reference are re-aimed as count-based models so
that log-probabilities are a distributed computation over the corpus:

* ``base``    unigram, add-one smoothed, over the base corpus;
* ``FT-M1B``  unigram over the training split, interpolated with ``base``
              (the "minus one block" variant: model order lowered by one);
* ``FT_full`` bigram over the training split, interpolated with ``base``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import tokens

BOS = "<s>"
LAMBDA = 0.5


def with_prev(toks: Column) -> Column:
    """Array of (prev, tok) pairs; the first token's predecessor is ``<s>``."""
    n = F.size(toks)
    prev = F.when(n > 0, F.concat(F.array(F.lit(BOS)), F.slice(toks, 1, F.greatest(n - 1, F.lit(0))))) \
        .otherwise(F.array().cast("array<string>"))
    return F.arrays_zip(prev.alias("prev"), toks.alias("tok"))


def positions(df: DataFrame, keys: list[str], toks: Column) -> DataFrame:
    """(keys..., pos, prev, tok) for a token-array column.

    The token array is projected first, so the tokenizing regex runs once
    per row although the (prev, tok) pairs refer to it several times.
    """
    staged = df.select(*keys, toks.alias("_toks"))
    return (staged.select(*keys, F.posexplode(with_prev(F.col("_toks"))).alias("pos", "pt"))
            .select(*keys, F.col("pos").cast("bigint").alias("pos"),
                    F.col("pt.prev").alias("prev"), F.col("pt.tok").alias("tok")))


@dataclass
class NgramModels:
    token_stats: DataFrame   # tok, c_doc, c_tr, c_prev (one row per token of either corpus)
    n_doc: int
    v_doc: int
    n_tr: int
    v_tr: int
    train_bi: DataFrame      # prev, tok, c_bi
    lam: float = LAMBDA


def _totals(stats: DataFrame):
    """Token and vocabulary totals of both corpora in one small job."""
    r = stats.agg(F.sum("c_doc").alias("n_doc"), F.count("c_doc").alias("v_doc"),
                  F.sum("c_tr").alias("n_tr"), F.count("c_tr").alias("v_tr")).first()
    # one extra vocabulary slot for unseen tokens
    return ((int(r["n_doc"] or 0), int(r["v_doc"] or 0) + 1),
            (int(r["n_tr"] or 0), int(r["v_tr"] or 0) + 1))


def fit(base_texts: DataFrame, train_texts: DataFrame, text_col: str = "text",
        train_col: str = "x", lam: float = LAMBDA) -> NgramModels:
    """Count tables of the three model variants (aggregates with map-side combine).

    Two tables are written once: the bigram counts of the training split, and
    per-token statistics (base-corpus count, training count, count as a
    bigram predecessor), so scoring needs no re-aggregation.
    """
    from papyra.session import materialize
    base_uni = (base_texts.select(F.explode(tokens(F.col(text_col))).alias("tok"))
                .groupBy("tok").agg(F.count(F.lit(1)).alias("c_doc")))
    tp = positions(train_texts, [], tokens(F.col(train_col)))
    train_bi = materialize(tp.groupBy("prev", "tok").agg(F.count(F.lit(1)).alias("c_bi")), "lm-train-bigrams")
    train_uni = train_bi.groupBy("tok").agg(F.sum("c_bi").alias("c_tr"))
    train_prev = train_bi.groupBy(F.col("prev").alias("tok")).agg(F.sum("c_bi").alias("c_prev"))
    stats = materialize(base_uni.join(train_uni, "tok", "full").join(train_prev, "tok", "full"), "lm-token-stats")
    (n_doc, v_doc), (n_tr, v_tr) = _totals(stats)
    return NgramModels(stats, n_doc, v_doc, n_tr, v_tr, train_bi, lam)


def ngram_logprobs(m: NgramModels, ngrams: DataFrame) -> DataFrame:
    """Log-probability of each distinct (prev, tok) under each variant.

    The joined tables are unique per key; the distinct n-grams repeat a token once
    per neighbour, which AQE splits where one neighbour is very common. Further
    columns of ``ngrams`` are kept.
    """
    kept = [c for c in ngrams.columns if c not in ("prev", "tok")]
    tok_stats = m.token_stats.select("tok", "c_doc", "c_tr")
    prev_stats = m.token_stats.select(F.col("tok").alias("prev"), "c_prev")
    g = ngrams.join(tok_stats, "tok", "left").join(m.train_bi, ["prev", "tok"], "left").join(prev_stats, "prev", "left")
    c = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    p_base = (c("c_doc") + 1.0) / F.lit(float(m.n_doc + m.v_doc))
    p_uni = (c("c_tr") + 1.0) / F.lit(float(m.n_tr + m.v_tr))
    p_bi = (c("c_bi") + 1.0) / (c("c_prev") + F.lit(float(m.v_tr)))
    return g.select("prev", "tok", *kept,
                    F.ln(p_base).alias("lp_base"),
                    F.ln(F.lit(m.lam) * p_uni + F.lit(1 - m.lam) * p_base).alias("lp_m1b"),
                    F.ln(F.lit(m.lam) * p_bi + F.lit(1 - m.lam) * p_base).alias("lp_full"))


VARIANT_COLUMNS = {"base": "lp_base", "FT_full": "lp_full", "FT-M1B": "lp_m1b"}


def score_positions(m: NgramModels, pos: DataFrame, keys: list[str], models=tuple(VARIANT_COLUMNS)) -> DataFrame:
    """(model, keys..., pos, tok, logprob) for every position and model variant.

    Log-probs are computed once per distinct n-gram and stored, then attached to
    the positions; the table's size is known, so Spark broadcasts a small one and
    shuffles a large one (AQE splits hot n-grams).
    """
    from papyra.session import materialize
    distinct = pos.select("prev", "tok").distinct()
    lp = materialize(ngram_logprobs(m, distinct), "lm-ngram-logprobs")
    scored = pos.join(lp, ["prev", "tok"], "inner")
    stack = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(VARIANT_COLUMNS[name]).alias("logprob"))
                                for name in models]))
    return scored.select(*keys, "pos", "tok", stack.alias("s")).select(
        F.col("s.model").alias("model"), *keys, "pos", "tok", F.col("s.logprob").alias("logprob"))


def token_logprobs(m: NgramModels, qna: DataFrame, models=tuple(VARIANT_COLUMNS)) -> DataFrame:
    r"""(model, id, pos, logprob, prompt_len) over the tokens of ``Q: q\nA: a``; the prompt is ``Q: q\nA:``.

    A null question or answer counts as empty, so every pair has the template's tokens at least.
    """
    from papyra.operators.evaluation import qna_full, qna_prompt
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    seq = qna.select("id", F.size(tokens(qna_prompt(q))).cast("bigint").alias("prompt_len"),
                     tokens(qna_full(q, a)).alias("seq"))
    pos = positions(seq, ["id", "prompt_len"], F.col("seq"))
    return score_positions(m, pos, ["id", "prompt_len"], models).select(
        "model", "id", "pos", "logprob", "prompt_len")


def masked_nll(tlp: DataFrame) -> DataFrame:
    """V3/V4: mean NLL over answer positions (prompt masked), and over all positions.

    Null when the answer has no tokens.
    """
    ans = F.col("pos") >= F.col("prompt_len")
    return tlp.groupBy("model", "id").agg(
        F.avg(F.when(ans, -F.col("logprob"))).alias("nll"),
        F.avg(-F.col("logprob")).alias("nll_full"),
        F.sum(ans.cast("bigint")).alias("n_answer_tokens"))


def perplexity(loss: Column) -> Column:
    """V5: exp(loss); null when the loss is absent or 0."""
    return F.when(loss.isNotNull() & (loss != 0), F.exp(loss))


def counted_ngrams(df: DataFrame, keys: list[str], toks: Column, answers_from: str | None = None) -> DataFrame:
    """(keys..., prev, tok, n, n_answer): occurrences of n-grams in the texts of a key, and those at a position of
    ``answers_from`` (a column) and later. Without keys one row per n-gram, counted within a task before it moves; with
    keys one row per position, which nothing has moved yet: a text hardly repeats an n-gram."""
    extra = [answers_from] if answers_from else []
    pos = positions(df, [*keys, *extra], toks)
    late = (F.col("pos") >= F.col(answers_from)).cast("bigint") if answers_from else F.lit(0).cast("bigint")
    each = pos.select(*keys, "prev", "tok", F.lit(1).cast("bigint").alias("n"), late.alias("n_answer"))
    return each if keys else each.groupBy("prev", "tok").agg(F.sum("n").alias("n"), F.sum("n_answer").alias("n_answer"))


def nll_of_counts(m: NgramModels, counted: DataFrame, keys: list[str], models=tuple(VARIANT_COLUMNS)) -> DataFrame:
    """(model, keys..., n_tokens, nll, n_answer_tokens, nll_answer) of ``counted_ngrams``.

    Log-probs are computed once per distinct n-gram; they meet the counts in a join in which no n-gram gathers in a task,
    and the sums of all variants are taken together before the rows are told apart by model. Without keys the counts are
    the distinct n-grams already, and are scored where they are.
    """
    from papyra.operators.blocks import heavy_join
    from papyra.session import materialize
    if keys:
        counted = materialize(counted, "ngram-counts")
        rows = counted.groupBy("prev", "tok").agg(F.count(F.lit(1)).alias("n"))
        lp = materialize(ngram_logprobs(m, rows), "lm-ngram-logprobs")   # the join reads it twice
        scored = heavy_join(counted, lp.drop("n"), ["prev", "tok"], counted=lp)
    else:
        scored = ngram_logprobs(m, counted)
    sums = [F.sum(F.col(w) * F.col(VARIANT_COLUMNS[name])).alias(f"{w}:{name}") for name in models for w in ("n", "n_answer")]
    total = scored.groupBy(*keys).agg(F.sum("n").alias("n_tokens"), F.sum("n_answer").alias("n_answer_tokens"), *sums)
    mean = lambda w, name, n: F.when(F.col(n) > 0, -F.col(f"`{w}:{name}`") / F.col(n))
    stack = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), mean("n", name, "n_tokens").alias("nll"),
                                         mean("n_answer", name, "n_answer_tokens").alias("nll_answer")) for name in models]))
    return total.select(*keys, "n_tokens", "n_answer_tokens", stack.alias("s")).select(
        F.col("s.model").alias("model"), *keys, "n_tokens", F.col("s.nll").alias("nll"), "n_answer_tokens",
        F.col("s.nll_answer").alias("nll_answer"))


def qna_nll(m: NgramModels, qna: DataFrame, models=tuple(VARIANT_COLUMNS)) -> DataFrame:
    r"""V3/V4: (model, id, nll, nll_full, n_answer_tokens): mean NLL of ``Q: q\nA: a`` over the answer's tokens (the prompt
    ``Q: q\nA:`` masked) and over all. Null when the answer has no tokens; a null question or answer counts as empty."""
    from papyra.operators.evaluation import qna_full, qna_prompt
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    seq = qna.select("id", F.size(tokens(qna_prompt(q))).cast("bigint").alias("prompt_len"), tokens(qna_full(q, a)).alias("seq"))
    found = nll_of_counts(m, counted_ngrams(seq, ["id"], F.col("seq"), "prompt_len"), ["id"], models)
    return found.select("model", "id", F.col("nll_answer").alias("nll"), F.col("nll").alias("nll_full"), "n_answer_tokens")


def text_nll(m: NgramModels, df: DataFrame, keys: list[str], text_col: str,
             models=tuple(VARIANT_COLUMNS)) -> DataFrame:
    """(model, keys..., n_tokens, nll) for each text under each variant; no tokens: 0 and a null NLL."""
    found = nll_of_counts(m, counted_ngrams(df, keys, tokens(F.col(text_col))), keys, models)
    every = df.select(F.explode(F.array(*[F.lit(x) for x in models])).alias("model"), *keys)
    return every.join(found, ["model", *keys], "left").select(
        "model", *keys, F.coalesce("n_tokens", F.lit(0).cast("bigint")).alias("n_tokens"), "nll")


def corpus_nll(m: NgramModels, df: DataFrame, text_col: str, models=tuple(VARIANT_COLUMNS)) -> DataFrame:
    """(model, n_tokens, nll) of all texts together."""
    return nll_of_counts(m, counted_ngrams(df, [], tokens(F.col(text_col))), [], models).select("model", "n_tokens", "nll")


def nll_by_group(docs: DataFrame, group_col: str, text_col: str = "text") -> DataFrame:
    """V5: mean NLL of all tokens of each group under the add-one unigram model of all groups together: (group, n_tokens,
    nll). One table of counts per (group, token) gives both the model and the sums."""
    from papyra.session import materialize
    counts = materialize(docs.select(group_col, F.explode(tokens(F.col(text_col))).alias("tok"))
                         .groupBy(group_col, "tok").agg(F.count(F.lit(1)).alias("n")), "group-counts")
    total = counts.groupBy("tok").agg(F.sum("n").alias("c"))
    size = total.agg(F.sum("c").alias("n"), F.count("c").alias("v")).first()
    p = (F.col("c").cast("double") + 1.0) / F.lit(float((size["n"] or 0) + size["v"] + 1))
    return counts.join(total, "tok").groupBy(group_col).agg(
        F.sum("n").alias("n_tokens"), (F.sum(F.col("n") * -F.ln(p)) / F.sum("n")).alias("nll"))
