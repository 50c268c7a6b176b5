"""Structured answers of models: parsing, scores, prompts and blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.functions.text import strip

_PROBABILITY = r"(?imd)^[ \t]*Probability:[ \t]*(\S.*?)[ \t\r]*$"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def probability(token: Column) -> dict[str, Column]:
    """Value, status (``ok``, ``missing``, ``invalid``, ``out_of_range``) and format warning of a probability as text."""
    value = F.when(token.rlike(_NUMBER), token.try_cast("double"))
    status = (
        F.when(token == "", "missing")
        .when(value.isNull(), "invalid")
        .when(~value.between(0, 1), "out_of_range")
        .otherwise("ok")
    )
    return {
        "probability": F.when(status == "ok", value),
        "probability_status": status,
        "probability_format_warning": (status == "ok") & ~token.rlike(r"^(?:0|1|0\.\d{2}|1\.00)$"),
    }


def parse_answers(df: DataFrame, text: str) -> DataFrame:
    """``df`` with prediction, parser_status, reasoning and the probability of each answer.

    In order: ``Prediction: Yes|No`` on the first line (structured); a first line that begins with
    the word (first_line); a whole line ``Prediction: ...`` anywhere (structured); the label
    within a line (fallback); the first such word anywhere (fallback); else unparseable, and then
    the probability counts as missing. Null and blank texts are unparseable.
    """
    t = strip(F.coalesce(F.col(text), F.lit("")))

    def taken_apart(x: Column) -> Column:
        first = strip(F.substring_index(x, "\n", 1))
        rest = strip(F.when(F.instr(x, "\n") > 0, F.substr(x, F.instr(x, "\n") + 1)).otherwise(F.lit("")))
        labelled = r"(?is)^(?:.*?\n)?[ \t]*Reasoning:\s*(.*)$"

        def word(pattern: str, of: Column) -> Column:
            return F.initcap(F.lower(F.regexp_extract(of, pattern, 1)))

        return F.struct(
            word(r"(?i)^Prediction\s*:\s*(Yes|No)\b", first).alias("a"),
            word(r"(?i)^(Yes|No)\b", first).alias("b"),
            word(r"(?imd)^[ \t]*Prediction:[ \t]*(Yes|No)[ \t\r]*$", x).alias("c"),
            word(r"(?i)Prediction:\s*(Yes|No)\b", x).alias("d"),
            word(r"(?i)\b(Yes|No)\b", x).alias("e"),
            x.alias("text"),
            rest.alias("rest"),
            F.when(x.rlike(labelled), strip(F.regexp_extract(x, labelled, 1))).otherwise(F.lit("")).alias("reason"),
            strip(F.regexp_extract(x, _PROBABILITY, 1)).alias("token"),
        )

    # In a lambda each pattern is matched once, and the generated code stays small.
    df = df.withColumn("__x", F.get(F.transform(F.array(t), taken_apart), F.lit(0)))
    x = lambda n: F.col(f"__x.{n}")
    steps = [("a", "structured", F.lit("")), ("b", "first_line", x("rest")), ("c", "structured", x("text")), ("d", "fallback", x("text"))]
    found, status, tail = F.when(x("e") != "", x("e")).otherwise("unparseable"), F.when(x("e") != "", "fallback").otherwise("unparseable"), x("text")
    by_label = F.lit(False)
    for n, name, other in reversed(steps):
        found = F.when(x(n) != "", x(n)).otherwise(found)
        status = F.when(x(n) != "", name).otherwise(status)
        tail = F.when(x(n) != "", other).otherwise(tail)
        by_label = by_label | (x(n) != "")
    # Where a word alone decides, the whole text is its reasoning.
    reasoning = F.when(~by_label, x("text")).when(x("reason") != "", x("reason")).otherwise(strip(tail))
    p = probability(x("token"))
    return (
        df.withColumns({"prediction": found, "parser_status": status, "reasoning": reasoning, **p})
        .withColumns(
            {
                "probability": F.when(F.col("parser_status") != "unparseable", F.col("probability")),
                "probability_format_warning": (F.col("parser_status") != "unparseable") & F.col("probability_format_warning"),
                "probability_status": F.when(F.col("parser_status") != "unparseable", F.col("probability_status")).otherwise("missing"),
                "pred_binary": F.when(F.col("prediction") == "Yes", 1).when(F.col("prediction") == "No", 0),
            }
        )
        .drop("__x")
    )


def two_way(yes: Column, no: Column) -> dict[str, Column]:
    """Probabilities and margin from the logits of two answers."""
    return {"prob_yes": 1 / (1 + F.exp(no - yes)), "prob_no": 1 / (1 + F.exp(yes - no)), "margin_logit": yes - no}


def request_key(*parts: Column) -> Column:
    """SHA-256 of a request, as the key of a cache of answers."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def narrative(diagnoses: Column, drugs: Column, procedures: Column, style: str = "bullet", most: int = 50) -> Column:
    """The three lists of a visit as bullets or as a paragraph; an empty list is ``None recorded``."""

    def text(items: Column) -> Column:
        joined = F.concat_ws("; ", F.slice(F.array_distinct(items), 1, most))
        # In a lambda the list is put together once.
        return F.get(F.transform(F.array(joined), lambda x: F.when(x == "", "None recorded").otherwise(x)), F.lit(0))

    d, m, p = text(diagnoses), text(drugs), text(procedures)
    if style == "paragraph":
        return F.format_string(
            "The patient was diagnosed with: %s. Medications prescribed included: %s. Procedures performed included: %s.", d, m, p
        )
    return F.format_string("- Diagnoses made: %s\n- Medications prescribed: %s\n- Procedures performed: %s", d, m, p)


def case_blocks(df: DataFrame, order: list[str], text: str, label: str) -> DataFrame:
    """One text of a few chosen rows: number, text and outcome of each case."""
    made = F.concat(
        F.lit("Case "), F.col("n").cast("string"), F.lit(":\n"), F.coalesce(F.col(text), F.lit("")),
        F.lit("\nOutcome: "), F.when(F.col(label) == 1, "Yes").otherwise("No"), F.lit("\n"),
    )
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*order, text, label))).alias("r"))  # a few exemplars
    return rows.select(F.posexplode("r").alias("i", "r")).select((F.col("i") + 1).alias("n"), "r.*").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n", made.alias("b")))), lambda x: x["b"])).alias("block")
    )


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each sentence that begins with a heading: ``key``, ``section``, ``content``."""
    sentence = F.explode(F.split(F.col(text), r"\n+|(?<=[.!?]) +"))
    return (
        df.where(F.col(text).isNotNull())
        .select(key, sentence.alias("s"))
        .select(
            key,
            strip(F.regexp_extract("s", r"^\s*(\w+):(.*)$", 1)).alias("section"),
            strip(F.regexp_extract("s", r"^\s*(\w+):(.*)$", 2)).alias("content"),
        )
        .where("section <> ''")
    )


#: Entities by name: label and the ways to write it; fixed values.
ENTITIES = {
    "cocaine": ("DRUG-USE", "cocaine"),
    "heroine": ("DRUG-USE", "heroine"),
    "morphine": ("DRUG-USE", "morphine"),
    "fentanyl": ("DRUG-USE", "fentanyl"),
    "heart failure": ("DIAGNOSIS", "heart failure"),
    "systolic chf": ("DIAGNOSIS", "systolic chf"),
    "diastolic chf": ("DIAGNOSIS", "diastolic chf"),
    "chronic kidney disease": ("DIAGNOSIS", "chronic kidney disease|ckd"),
    "chronic obstructive pulmonary disease": ("DIAGNOSIS", "chronic obstructive pulmonary disease|copd"),
    "coronary artery disease": ("DIAGNOSIS", "coronary artery disease|cad"),
    "insulin": ("MEDICATION", "insulin"),
    "heparin": ("MEDICATION", "heparin"),
    "furosemide": ("MEDICATION", "furosemide|lasix"),
    "norepinephrine": ("MEDICATION", "norepinephrine"),
    "warfarin": ("MEDICATION", "warfarin"),
    "metoprolol": ("MEDICATION", "metoprolol"),
    "shortness of breath": ("SYMPTOM", "shortness of breath|sob"),
    "chest pain": ("SYMPTOM", "chest pain"),
    "fever": ("SYMPTOM", "fever"),
    "abdominal pain": ("SYMPTOM", "abdominal pain"),
    "headache": ("SYMPTOM", "headache"),
    "fatigue": ("SYMPTOM", "fatigue"),
    "diarrhea": ("SYMPTOM", "diarrhea"),
    "edema": ("SYMPTOM", "edema"),
    "palpitations": ("SYMPTOM", "palpitations"),
}
#: What says how an entity after it is meant; fixed values.
CONTEXTS = {
    "family": "family history|mother had|father had|sister had|brother had|maternal|paternal|hereditary|genetic",
    "severe": "mild|severe",
    "current": "presenting with",
    "historical": "past|history of",
    "negated": "no|denies|lack|self-discontinuing",
}
#: What says how an entity before it is meant; fixed values.
BACKWARD = {"family": "runs in the family"}


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """Entities named in texts, with whether each is of the family, graded, current, historical or negated.

    A context reaches forward to the end of the clause (the sentence, or a semicolon), those of
    ``BACKWARD`` to its begin. One row for each text, clause, entity and ``mention`` of it, from 1.
    """
    clauses = df.where(F.col(text).isNotNull()).select(
        key, F.posexplode(F.split(F.lower(F.col(text)), r"\n+|(?<=[.!?]) +|;")).alias("clause", "c")
    )
    # The clause split at each entity; the patterns are fixed, so each is compiled once.
    found = F.array_compact(
        F.array(*[
            F.when(
                F.col("c").rlike(rf"\b(?:{ways})\b"),
                F.struct(F.lit(name).alias("entity"), F.lit(label).alias("label"), F.split(F.col("c"), rf"\b(?:{ways})\b", -1).alias("around")),
            )
            for name, (label, ways) in ENTITIES.items()
        ])
    )
    one = clauses.select(key, "clause", F.explode(found).alias("e")).select(key, "clause", "e.*")
    each = one.withColumn("mention", F.explode(F.sequence(F.lit(1), F.size("around") - 1)))
    before = F.array_join(F.slice("around", F.lit(1), F.col("mention")), " | ")
    after = F.array_join(F.slice("around", F.col("mention") + 1, F.size("around")), " | ")
    said = {n: before.rlike(rf"\b(?:{w})\b") for n, w in CONTEXTS.items()}
    said |= {n: said[n] | after.rlike(rf"\b(?:{w})\b") for n, w in BACKWARD.items()}
    return each.select(key, "clause", "entity", "label", "mention", *[c.alias(n) for n, c in said.items()])


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean of each key's vectors and that at length one, entry by entry; vectors are added up as such before the shuffle.

    All vectors must have one length; null ones are left out.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    means = vectors.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    flat = means.withColumn("length", length).select(key, "length", F.posexplode("m").alias("i", "mean"))
    return flat.select(key, "i", "mean", F.when(F.col("length") > 0, F.col("mean") / F.col("length")).otherwise(0.0).alias("unit"))


def scored(df: DataFrame, scorer, schema: str) -> DataFrame:  # noqa: ANN001
    """``df`` through ``scorer``, a function from an iterator of record batches to one: the place for a model."""
    return df.mapInArrow(scorer, schema)


def logprob_confidence(top: Column) -> dict[str, Column]:
    """Probabilities of yes and no from the first token's map of log probabilities; null where it has neither."""
    def most(words: list[str]) -> Column:
        kept = F.map_filter(top, lambda k, _: strip(k).isin(words))
        return F.array_max(F.map_values(kept))

    yes, no = most(["Yes", "yes", "YES"]), most(["No", "no", "NO"])
    high = F.greatest(yes, no)
    a, b = F.coalesce(F.exp(yes - high), F.lit(0.0)), F.coalesce(F.exp(no - high), F.lit(0.0))
    return {"prob_yes": F.when(high.isNotNull(), a / (a + b)), "prob_no": F.when(high.isNotNull(), b / (a + b))}


def verdict(pred: Column, y: Column) -> Column:
    """Of an answer: correct, wrong or unparseable."""
    return F.when(pred.isNull(), "unparseable").when(pred == y, "correct").otherwise("wrong")


def critic_block(n: Column, text: Column, y: Column, prediction: Column, reasoning: Column, most: int = 500) -> Column:
    """A wrong answer as a numbered sample for a critic; an empty reasoning is left out."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("--- Sample "), n.cast("string"), F.lit(" ---")),
        F.lit("[Patient Medical History]"),
        F.coalesce(text, F.lit("")),
        F.concat(F.lit("[Actual Outcome] "), F.when(y == 1, "Yes").otherwise("No")),
        F.concat(F.lit("[Wrong Prediction] "), prediction),
        F.when(F.coalesce(reasoning, F.lit("")) != "", F.concat(F.lit("[Predictor Reasoning] "), F.left(reasoning, F.lit(most)))),
    )


def two_agent_rounds(df: DataFrame, predict, criticise, rounds: int = 1) -> tuple[DataFrame, str]:  # noqa: ANN001
    """Predict, let a critic see the wrong rows, predict again with its advice; stops where nothing is wrong.

    ``predict`` takes (df, advice) and gives df with ``pred`` and ``y``; ``criticise`` takes the wrong rows and gives
    advice. Returns the last predictions and the advice, pieces joined by ``---``.
    """
    advice: list[str] = []
    out = predict(df, "")
    for _ in range(rounds):
        wrong = out.where(F.col("pred").isNotNull() & (F.col("pred") != F.col("y")))
        if wrong.isEmpty():
            break
        advice.append(criticise(wrong))
        out = predict(df, "\n---\n".join(advice))
    return out, "\n---\n".join(advice)


def standardised(signal: Column, limit: float = 5.0) -> Column:
    """A signal as z-scores within ``limit``, then brought to 0 to 1; a flat one is 0 everywhere."""

    def let(value: Column, f) -> Column:  # noqa: ANN001
        # Evaluates ``value`` once for all its uses in ``f``.
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)

    def spread_out(z: Column, low: Column, high: Column) -> Column:
        return F.transform(z, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.0))

    def scaled_by(s: Column, mean: Column, sd: Column) -> Column:
        z = F.transform(s, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.when(sd > 0, (x - mean) / sd).otherwise(0.0))))
        return let(z, lambda v: let(F.array_min(v), lambda low: let(F.array_max(v), lambda high: spread_out(v, low, high))))

    def centred(s: Column, mean: Column) -> Column:
        sd = F.sqrt(total(F.transform(s, lambda x: (x - mean) * (x - mean))) / F.size(s))
        return let(sd, lambda d: scaled_by(s, mean, d))

    return let(signal, lambda s: let(total(s) / F.size(s), lambda m: centred(s, m)))


def fixed_length(signal: Column, n: int) -> Column:
    """The centre of a signal, or the signal with zeros on both sides, at length ``n``."""
    size = F.size(signal)
    before = F.floor((F.lit(n) - size) / 2).cast("int")
    start = (F.floor((size - n) / 2) + 1).cast("int")
    zeros = lambda c: F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), c))
    return F.when(size >= n, F.slice(signal, F.greatest(F.lit(1), start), F.lit(n))).otherwise(
        F.concat(zeros(before), signal, zeros(F.lit(n) - size - before))
    )
