"""Prompts and requests: templates, instructions, cache keys, completion of rows, rounds of a critic."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.operators.sampling import hash_ranked

_BLOCK = re.compile(r"\{%\s*block\s+(\w+)\s*%\}(.*?)\{%\s*endblock\s*%\}", re.S)
_COMMENT = re.compile(r"\{#.*?#\}", re.S)
_RAW = re.compile(r"\{%\s*(?:end)?raw\s*%\}")
_SLOT = re.compile(r"\{\{\s*(\w+)\s*\}\}")

#: The template of each way to ask; fixed values.
TEMPLATES = {
    "zero_shot": "predictor_zero_shot.txt",
    "zero_shot_plus": "predictor_zero_shot_plus.txt",
    "few_shot": "predictor_few_shot.txt",
    "coagent_calibration": "predictor_few_shot.txt",
    "coagent": "predictor_coagent_base.txt",
}


def template_of(mode: str) -> str:
    """The file of the template of a way to ask; a ValueError for an unknown one."""
    if mode not in TEMPLATES:
        raise ValueError(f"unknown mode {mode}")
    return TEMPLATES[mode]


def blocks(template: str) -> dict[str, str]:
    """The named blocks of a template, stripped; marks of raw text are taken out."""
    return {m.group(1): m.group(2).strip() for m in _BLOCK.finditer(_RAW.sub("", template))}


def rendered(template: str, variables: dict[str, Column | str]) -> Column:
    """A block with its slots ``{{ name }}`` filled, row by row; comments go, unknown names and nulls give ''.

    Slots are all that can be filled; a ValueError names any other mark.
    """
    text = _COMMENT.sub("", template)
    if found := re.search(r"\{%.*?%\}", text):
        raise ValueError(f"can't render {found.group()}")
    parts: list[Column] = []
    at = 0
    for m in _SLOT.finditer(text):
        value = variables.get(m.group(1), "")
        column = F.coalesce(value.cast("string"), F.lit("")) if isinstance(value, Column) else F.lit(str(value))
        parts += [F.lit(text[at : m.start()]), column]
        at = m.end()
    whole = F.concat(*parts, F.lit(text[at:])) if parts else F.lit(text)
    return F.regexp_replace(whole, r"^\s+|\s+$", "")


def messages(template: str, variables: dict[str, Column | str]) -> Column:
    """The messages of a request as an array of role and content: the blocks system and user, as far as there are."""
    found = blocks(template)
    return F.array(*[F.struct(F.lit(r).alias("role"), rendered(found[r], variables).alias("content")) for r in ("system", "user") if r in found])


def flat_prompt(chat: Column) -> Column:
    """Messages as one text: each role in capitals, a colon and a line end, and its content; a line between them is empty."""
    return F.array_join(F.transform(chat, lambda m: F.concat(F.upper(m["role"]), F.lit(":\n"), m["content"])), "\n\n")


def instruction(task: str, text: Column, label: Column | None = None) -> Column:
    """A line of the task, the record, and the answer asked for; with ``label`` the answer, too (Yes for 1, else No)."""
    ask = F.concat(F.lit(f"Task: {task}\n\nPatient record:\n"), F.coalesce(text, F.lit("")), F.lit("\n\nPrediction:\n"))
    return ask if label is None else F.concat(ask, F.when(label == 1, "Yes").otherwise("No"))


def _json_text(c: Column) -> Column:
    """A text as JSON in ASCII."""
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)

    def sign(x: Column) -> Column:
        code = F.ascii(x)
        four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
        pair = F.concat(four(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), four(F.lit(0xDC00) + ((code - 0x10000) % 1024)))
        return F.when(code < 128, x).when(code < 0x10000, four(code)).otherwise(pair)

    return F.when(quoted.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(quoted, ""), sign), "")).otherwise(quoted)


def canonical_key(chat: Column, model: Column, temperature: Column, seed: Column) -> Column:
    """SHA-256 of a request as JSON with sorted keys, ``", "`` and ``": "`` between, in ASCII; a null seed is ``null``."""
    one = F.transform(chat, lambda m: F.concat(F.lit('{"content": '), _json_text(m["content"]), F.lit(', "role": '), _json_text(m["role"]), F.lit("}")))
    text = F.concat(
        F.lit('{"messages": ['), F.array_join(one, ", "), F.lit('], "model": '), _json_text(model), F.lit(', "seed": '), F.coalesce(seed.cast("string"), F.lit("null")),
        F.lit(', "temperature": '), temperature.cast("double").cast("string"), F.lit("}"),
    )
    return F.sha2(text, 256)


def uncached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """One row for each request whose key the cache lacks, so that equal ones are sent once."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def completed(df: DataFrame, prompt: str, complete: Callable[[list[str]], list[str]], name: str = "text") -> DataFrame:
    """``df`` with the answer of ``complete``, which takes a batch of prompts: the place for a model or client.

    Where it fails for a batch, its prompts are given one by one; what fails then, and null, gives ''.
    """
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*df.schema.fields]).add(name, StringType())

    def one(p: str) -> str:
        try:
            return complete([p])[0] or ""
        except Exception:  # noqa: BLE001
            return ""

    def run(frames: Iterator) -> Iterator:  # noqa: ANN401
        for f in frames:
            prompts = ["" if p is None else str(p) for p in f[prompt]]
            try:
                got = [t or "" for t in complete(prompts)]
            except Exception:  # noqa: BLE001
                got = [one(p) for p in prompts]
            yield f.assign(**{name: got})

    return df.mapInPandas(run, schema)


def hard_label(first: Column, prediction: Column, status: Column, prob_yes: Column, prob_no: Column) -> dict[str, Column]:
    """Label and its source: the first token if it is yes or no, else what the parser found, else the greater probability."""
    word = F.lower(F.trim(first))
    source = (
        F.when(word == "yes", "first_token_yes").when(word == "no", "first_token_no").when(prediction.isin("Yes", "No"), status).otherwise("logits_fallback")
    )
    label = F.when(word == "yes", 1).when(word == "no", 0).when(prediction == "Yes", 1).when(prediction == "No", 0).when(prob_yes >= prob_no, 1).otherwise(0)
    return {"label": label, "answer": F.when(label == 1, "Yes").otherwise("No"), "source": source}


def critic_rounds(wrong: DataFrame, key: str, size: int, rounds: int, seed: int = 0) -> DataFrame:
    """``wrong`` rows in ``rounds`` batches of ``size``, by turns in order of the hash and from the begin again at the end; ``round`` and ``place`` from 0."""
    ranked = hash_ranked(wrong.withColumn("__all", F.lit(1)), ["__all"], key, seed).drop("__all")
    n = wrong.agg(F.count(F.lit(1)).alias("__n"))
    at = F.col("rank") - 1
    turns = F.when(F.lit(rounds * size - 1) >= at, F.sequence(F.lit(0).cast("bigint"), F.floor((F.lit(rounds * size - 1) - at) / F.col("__n"))))
    out = ranked.crossJoin(F.broadcast(n)).withColumn("__k", F.explode(turns))  # one row
    place = F.col("rank") - 1 + F.col("__k") * F.col("__n")
    return out.withColumn("round", F.floor(place / size)).withColumn("place", place % size).drop("rank", "__n", "__k")


def consolidated(pieces: list[str], method: str = "heuristic", complete: Callable[[list[str]], list[str]] | None = None) -> str:
    """Advice put together: ``heuristic`` numbers the pieces that aren't empty and joins them by ``---``, ``llm`` lets ``complete`` write one text of that.

    Where ``complete`` fails or gives nothing, the joined pieces are taken.
    """
    text = "\n\n---\n\n".join(f"Batch {i}:\n{p}" for i, p in enumerate(pieces, 1) if p)
    if method == "heuristic" or not text:
        return text
    if method != "llm" or complete is None:
        raise ValueError(f"can't consolidate by {method}")
    try:
        return complete([text])[0].strip() or text
    except Exception:  # noqa: BLE001
        return text


def out_of_fold(df: DataFrame, fold: str, k: int, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], DataFrame]) -> DataFrame:
    """All rows, each scored by a model fitted on the other folds."""
    out = None
    for i in range(k):
        part = score(fit(df.where(F.col(fold) != i)), df.where(F.col(fold) == i))
        out = part if out is None else out.unionByName(part)
    return out
