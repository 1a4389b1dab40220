"""Text preparation: cleaning, sentence repair, classification, script statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    HashingTF,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.functions.text import sanitize
from glossweave.plans.scale import HOT_ROWS, running_sum
from glossweave.session import stored

# (rule, pattern, replacement), applied in this order.
ARTIFACT_RULES = [
    ("junk_marks", r"[#%&$*]{3}", ""),
    ("shout", r"!{2,}", "!"),
    ("gap_before_mark", r" +([,.;:!?])", "$1"),
    ("comma_stop", r",\.", "."),
    ("wide_gap", r" {2,}", " "),
]

# (class, pattern): the first match wins.
TEXT_RULES = [
    ("noise", r"^[^\p{L}]*$"),
    ("sound", r"^[\p{Lu}!?. ,-]{1,40}!+$"),
    ("caption", r":$|^\[.*\]$|^\(.*\)$"),
    ("speech", r"[.!?]\"?$"),
]
DEFAULT_CLASS = "other"

# Script name, and the language bucket a dominant script implies.
SCRIPTS = [
    ("latin", "Latin", "latin"),
    ("han", "Han", "zh"),
    ("hiragana", "Hiragana", "ja"),
    ("katakana", "Katakana", "ja"),
    ("hangul", "Hangul", "ko"),
]

# Common letters that only simplified, or only traditional, Chinese has.
SIMPLIFIED = "们这个来时为说国会对发经过现实开关见问间题学习语话读书写车东门马鸟鱼龙龟亲爱听买卖头风飞电脑网边还进远运动点热气汉译"
TRADITIONAL = "們這個來時為說國會對發經過現實開關見問間題學習語話讀書寫車東門馬鳥魚龍龜親愛聽買賣頭風飛電腦網邊還進遠運動點熱氣漢譯"

SENTENCE_END = r"[.!?。！？…][\"'”’)\]」』]*$"


def sanitize_text(df: DataFrame, col: str) -> DataFrame:
    """``col`` without control characters, entities, wide forms and repeated white space."""
    return df.withColumn(col, sanitize(F.col(col)))


def clean_artifacts(
    df: DataFrame, col: str, rules: Sequence[tuple[str, str, str]] = ARTIFACT_RULES
) -> DataFrame:
    """Apply the ordered rules to ``col`` and add ``hit_<rule>``: did the rule find anything?"""
    for name, pattern, replacement in rules:
        replaced = F.regexp_replace(col, pattern, replacement)
        df = df.withColumn(f"hit_{name}", F.col(col).rlike(pattern)).withColumn(
            col, F.when(F.col(f"hit_{name}"), replaced).otherwise(F.col(col))
        )
    return df


def artifact_hits(
    df: DataFrame, col: str, rules: Sequence[tuple[str, str, str]] = ARTIFACT_RULES
) -> DataFrame:
    """Rows changed per rule as (rule, n_rows)."""
    cleaned = clean_artifacts(df.select(col), col, rules)
    counts = cleaned.agg(*[F.count_if(f"hit_{name}").alias(name) for name, _, _ in rules])
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows"))
                    for n, _, _ in rules
                ]
            )
        ).alias("_r")
    ).select("_r.rule", "_r.n_rows")


def restore_sentences(
    segments: DataFrame,
    order: str = "pos",
    key: str = "doc_id",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Join fragments until one ends a sentence: (key, sentence_no, first_pos, n_parts, text).

    The sentence number is the count of sentence ends before a fragment.
    """
    ends = segments.select(key, order, "text").withColumn(
        "_end", F.regexp_like("text", F.lit(SENTENCE_END)).cast("long")
    )
    numbered = running_sum(
        ends,
        [key],
        [F.col(order)],
        F.col("_end"),
        "_ends",
        limit,
    ).withColumn("sentence_no", F.col("_ends") - F.col("_end"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text"))))
    return (
        numbered.groupBy(key, "sentence_no")
        .agg(parts.alias("_p"))
        .select(
            key,
            "sentence_no",
            F.element_at("_p", 1)[order].alias("first_pos"),
            F.size("_p").alias("n_parts"),
            F.array_join(F.col("_p.text"), " ").alias("text"),
        )
    )


def classify_text(
    df: DataFrame,
    rules: Sequence[tuple[str, str]] = TEXT_RULES,
    col: str = "text",
    default: str = DEFAULT_CLASS,
) -> DataFrame:
    """Add ``text_class``: the first rule whose pattern matches ``col``."""
    chosen = None
    for name, pattern in rules:
        cond = F.col(col).rlike(pattern)
        chosen = F.when(cond, name) if chosen is None else chosen.when(cond, name)
    return df.withColumn("text_class", chosen.otherwise(default))


#: Figures of a text's structure, as SQL expressions.
STRUCTURE = {
    "_length": "log1p(length(text))",
    "_letters": r"length(regexp_replace(text, '\\P{L}+', '')) / (1 + length(text))",
    "_digits": "length(regexp_replace(text, '[^0-9]+', '')) / (1 + length(text))",
    "_capitals": r"length(regexp_replace(text, '\\P{Lu}+', '')) / (1 + length(text))",
    "_marks": r"length(regexp_replace(text, '[\\p{L}\\p{N}\\s]+', '')) / (1 + length(text))",
    "_distinct": r"size(array_distinct(split(lower(text), '\\s+'))) / size(split(text, '\\s+'))",
    "_repeats": r"regexp_count(text, '(?<!\\S)(\\S+)(?=\\s\\1(?!\\S))') / size(split(text, '\\s+'))",
    "_bare": r"regexp_count(text, '(?<!\\S)[^\\p{L}\\s]+(?!\\S)') / size(split(text, '\\s+'))",
    "_word": r"length(text) / size(split(text, '\\s+'))",
    "_lines": r"size(array_distinct(split(text, '\n'))) / size(split(text, '\n'))",
    "_sentence": "length(text) / size(split(text, '[.!?]'))",
}


def text_features(docs: DataFrame, features: int = 1 << 14) -> DataFrame:
    """(doc_id, _words, figures): hashed words of unit length, and ``STRUCTURE``.

    Store it if a model is to be fitted and applied, so that the texts are read once.
    """
    figures = ", ".join(f"coalesce(CAST({e} AS double), 0.0) AS {n}" for n, e in STRUCTURE.items())
    stages = [
        SQLTransformer(statement=f"SELECT *, {figures} FROM __THIS__"),
        RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\p{L}+", gaps=False),
        HashingTF(inputCol="_w", outputCol="_counts", numFeatures=features),
        Normalizer(inputCol="_counts", outputCol="_words"),
    ]
    return PipelineModel(stages=stages).transform(docs.select("doc_id", "text")).select("doc_id", "_words", *STRUCTURE)


def _described(docs: DataFrame, features: int = 1 << 14) -> DataFrame:
    return docs if "_words" in docs.columns else text_features(docs, features)


def train_text_classifier(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    features: int = 1 << 14,
    max_iter: int = 40,
) -> PipelineModel:
    """Fit a logistic regression on the labelled documents, or on their stored ``text_features``.

    Features are the hashed words of a text, of unit length, and figures of its structure
    (``STRUCTURE``), scaled to unit deviation.
    """
    marked = labels.select("doc_id", F.col(label).cast("double").alias("label"))
    train = stored(_described(docs.join(marked.select("doc_id"), "doc_id", "left_semi"), features), "features").join(marked, "doc_id")
    stages = [
        VectorAssembler(inputCols=list(STRUCTURE), outputCol="_structure"),
        StandardScaler(inputCol="_structure", outputCol="_scaled", withMean=True),
        VectorAssembler(inputCols=["_words", "_scaled"], outputCol="features"),
        LogisticRegression(maxIter=max_iter, regParam=0.01, standardization=False),
    ]
    return Pipeline(stages=stages).fit(train)


def score_text(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """Scores for all rows, texts or their ``text_features``, as (doc_id, predicted, score)."""
    size = model.stages[-1].numFeatures - len(STRUCTURE)
    return model.transform(_described(docs, size)).select(
        "doc_id",
        F.col("prediction").cast("int").alias("predicted"),
        vector_to_array("probability")[1].alias("score"),
    )


def ranking_quality(scored: DataFrame, labels: DataFrame, label: str = "quality") -> float:
    """Area under the ROC curve of (doc_id, score) on labelled rows; give it held-out ones."""
    rows = scored.join(labels.select("doc_id", F.col(label).cast("double").alias("label")), "doc_id")
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label")
    return evaluator.evaluate(rows.filter(F.col("label").isNotNull()))


def script_profile(df: DataFrame, col: str = "text") -> DataFrame:
    """Add letters per script (``n_<script>``), ``dominant_script`` and ``lang_bucket``.

    Kana decide for Japanese even where Han letters prevail, since Chinese text has none.
    ``zh_variant`` tells simplified from traditional Chinese by letters that only one of
    them has; it is null unless the bucket is Chinese and one kind prevails.
    """
    # Scripts share no letters, so each is counted in what the earlier ones left over.
    out = df.withColumn("_rest", F.col(col))
    for name, prop, _ in SCRIPTS:
        out = (
            out.withColumn("_less", F.regexp_replace("_rest", rf"\p{{Is{prop}}}+", ""))
            .withColumn(f"n_{name}", F.length("_rest") - F.length("_less"))
            .withColumn("_rest", F.col("_less"))
        )
    out = out.drop("_rest", "_less")
    top = F.greatest(*[F.col(f"n_{n}") for n, _, _ in SCRIPTS])
    dominant = F.when(top == 0, "none")
    bucket = F.when(top == 0, "none").when(
        (F.col("n_hiragana") + F.col("n_katakana") > 0)
        & (F.greatest("n_hiragana", "n_katakana", "n_han") == top),
        "ja",
    )
    for name, _, lang in SCRIPTS:
        dominant = dominant.when(F.col(f"n_{name}") == top, name)
        bucket = bucket.when(F.col(f"n_{name}") == top, lang)
    out = out.withColumn("dominant_script", dominant).withColumn("lang_bucket", bucket)

    def among(letters: str) -> Column:
        return F.length(col) - F.length(F.translate(col, letters, ""))

    balance = among(SIMPLIFIED) - among(TRADITIONAL)
    variant = F.when(balance > 0, "simplified").when(balance < 0, "traditional")
    return out.withColumn("zh_variant", F.when(F.col("lang_bucket") == "zh", variant))


def dedup_content(df: DataFrame, col: str, key: str) -> DataFrame:
    """One row per content hash (sha256, <key> = lowest id, n_copies)."""
    return df.groupBy(F.sha2(F.col(col), 256).alias("sha256")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies")
    )
