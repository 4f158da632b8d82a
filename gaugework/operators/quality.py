"""Answer quality: accuracy, text overlap, consistency and loss against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import any_contains, half_even, or_zero, safe_div
from gaugework.functions.text import lcs, word_tokens
from gaugework.sources.catalog import PROMPT_TEMPLATES


TEXT_KEY = ["__digest", "__length"]


def text_key(column: str) -> list[Column]:
    """Digest and length of a text, in place of the text itself as a key."""
    return [F.unhex(F.md5(column)).alias(TEXT_KEY[0]), F.length(column).alias(TEXT_KEY[1])]


def graded(responses: DataFrame, answer_key: DataFrame) -> DataFrame:
    """Responses to prompts that the key knows, each marked right or wrong.

    Prompts meet by digest and length, so that whole texts are no join keys.
    """
    known = answer_key.select(*text_key("prompt"), "keywords")
    return (
        responses.withColumns(dict(zip(TEXT_KEY, text_key("prompt")))).join(known, TEXT_KEY).drop(*TEXT_KEY)
        .withColumn("is_correct", any_contains("text", "keywords"))
    )


def task_accuracy(responses: DataFrame, answer_key: DataFrame,
                  keys: list[str] = ("model_name", "quantization"), digits: int = 4) -> DataFrame:
    """Share of right answers per group. Without keys one row always comes back, 0 for none graded."""
    marks = graded(responses, answer_key)
    return marks.groupBy(*keys).agg(
        F.coalesce(half_even(F.avg(F.col("is_correct").cast("double")), digits), F.lit(0.0))
        .alias("task_accuracy"),
        F.count_if("is_correct").alias("num_correct"),
        F.count(F.lit(1)).alias("num_samples"))


def with_rouge_l(pairs: DataFrame, generated: str = "text", reference: str = "reference",
                 out: str = "rouge_l") -> DataFrame:
    """F measure of the longest common subsequence of whole texts (Lin, 2004).

    Tokens are cut by a built-in expression; only the subsequence length, which
    has no affordable built-in form, is computed in Arrow batches.
    """
    tokens = pairs.withColumns({"__g": word_tokens(generated), "__r": word_tokens(reference)})
    precision = safe_div("__lcs", F.size("__g"))
    recall = safe_div("__lcs", F.size("__r"))
    return (
        tokens.withColumn("__lcs", lcs("__g", "__r"))
        .withColumns({"__p": precision, "__rc": recall})
        .withColumn(out, safe_div(2 * F.col("__p") * F.col("__rc"), F.col("__p") + F.col("__rc")))
        .drop("__g", "__r", "__lcs", "__p", "__rc")
    )


def rouge_l(generated: DataFrame, references: DataFrame, keys: list[str] = ("model_name", "quantization"),
            digits: int = 4) -> DataFrame:
    """Mean ROUGE-L per group over texts paired by ``pair_id``; unpaired texts do not count."""
    pairs = generated.join(references.select("pair_id", "reference"), "pair_id")
    return with_rouge_l(pairs).groupBy(*keys).agg(
        half_even(F.avg("rouge_l"), digits).alias("rouge_l_score"),
        F.count(F.lit(1)).alias("num_samples"))


def consistency(outputs: DataFrame, keys: list[str] = ("model_name",), prompt: str = "prompt",
                text: str = "text", digits: int = 4) -> DataFrame:
    """Share of prompts, among those with two outputs or more, whose outputs are all alike.

    Texts are told apart by their SHA-256 digest, so no text is shuffled or
    collected. Counting per digest first spreads a prompt that is asked very
    often and leaves one row per different answer.
    """
    per_answer = outputs.groupBy(*keys, prompt, F.sha2(F.trim(text), 256).alias("__answer")).agg(
        F.count(F.lit(1)).alias("__n"))
    per_prompt = per_answer.groupBy(*keys, prompt).agg(
        F.sum("__n").alias("runs"), (F.count(F.lit(1)) == 1).alias("alike"))
    return per_prompt.filter("runs >= 2").groupBy(*keys).agg(
        half_even(F.avg(F.col("alike").cast("double")), digits).alias("consistency_score"),
        F.count_if("alike").alias("num_consistent"),
        F.count(F.lit(1)).alias("num_samples"))


def against_baseline(results: DataFrame, baseline: str = "fp16") -> DataFrame:
    """Accuracy and overlap deltas of each variant against the baseline of its model.

    A missing score counts as 0; the baseline itself and models without one
    have no delta.
    """
    scores = [c for c in ("task_accuracy", "rouge_l_score") if c in results.columns]
    base = results.filter(F.col("quantization") == baseline).select(
        "model_name", *[F.col(c).alias(f"__{c}") for c in scores], F.lit(True).alias("__has"))
    joined = results.join(base, "model_name", "left")
    wanted = F.col("__has") & (F.col("quantization") != baseline)
    names = {"task_accuracy": "accuracy_delta", "rouge_l_score": "rouge_delta"}
    return joined.withColumns({
        names[c]: F.when(wanted, or_zero(c) - or_zero(f"__{c}")) for c in scores
    }).select(*results.columns, *[names[c] for c in scores])


def build_prompts(docs: DataFrame, templates: list[tuple] = PROMPT_TEMPLATES, text: str = "text") -> DataFrame:
    """Fill the templates whose token range holds the document.

    The range test comes before the text is copied into a template, so a
    document is multiplied only by the templates it fits.
    """
    options = F.array(*[
        F.struct(F.lit(i).alias("template_id"), F.lit(w).alias("workload"), F.lit(t).alias("template"),
                 F.lit(hole).alias("hole"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        for i, (w, t, hole, lo, hi) in enumerate(templates)])
    fitting = F.filter(
        options, lambda t: (F.col("n_tokens") >= t["lo"]) & (F.col("n_tokens") <= t["hi"]))
    return (
        docs.withColumn("n_tokens", F.regexp_count(text, F.lit(r"\S+")))
        .withColumn("__t", F.explode(fitting))
        .withColumn("prompt", F.replace(F.col("__t.template"), F.col("__t.hole"), F.col(text)))
        .select(*docs.columns, "n_tokens", "__t.workload", "__t.template_id", "prompt")
    )
