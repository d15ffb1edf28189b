"""Decisions that the pipelines leave to a model, behind one interface.

A decider maps (kind, inputs) to a struct column of the kind's schema; null means that the model failed. There are three:
Recorded looks decisions up by a hash of their inputs, Rules are offline stand-ins by plain string comparison (reproducible, and not
equivalent to any model), and Live calls a function for batches of inputs. Rows outside where, which a pipeline has already
decided, are not asked and get null.

A Live decision is written down in the shared folder before anything reads it, so each row is asked once, whatever is made of the answers
and however often; a function that answers differently each time can't put a row into two branches or none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.durable import durable
from quillon.functions import text as T

#: What each kind of decision answers with.
SCHEMAS = {
    "clause_match": "needs_lookup boolean",
    "best_match": "best_index int, confidence string",
    "targeted_context": "snippet string",
    "deviation": "has_deviation boolean, deviation_type string",
    "section_label": "section string",
    "comment": "comments string",
    "grounding": "grounded boolean, issues string",
    "materiality": "score int, severity string",
    "field_match": "match boolean, reason string",
    "form_fields": "fields array<struct<name:string,value:string,page:int>>",
    "toc": "is_toc boolean",
    "heading_rank": "headings array<int>",
    "pick_best": "index int",
    "whole_comparison": "items array<struct<section:string,base_page:int,compare_page:int,base_paragraph:string,compare_paragraph:string,deviation:boolean,comments:string>>",
    "verify": "verified boolean, output string",
    "terms": "terms array<string>",
    "synthesis": "output string",
    "retrieve": "response string",
    "relevance": "response string",
    "generate": "response string",
    "support": "response string",
    "utility": "response int",
}
CONFIDENCE = ("High", "Medium", "Low")
DEVIATION_TYPES = ("addition", "omission", "modification", "contradiction", "none")
SEVERITY = ("Low", "Medium", "High", "N/A")


class Decider(Protocol):
    def decide(self, rows: DataFrame, kind: str, inputs: dict[str, Column], out: str, where: Column | None = None) -> DataFrame: ...


def input_hash(inputs: dict[str, Column]) -> Column:
    """What names a decision: a digest of its inputs by name."""
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(inputs.items())))), 256)


class Recorded:
    """Decisions from a table: kind, input_hash, payload (JSON). What is not recorded is a failure."""

    def __init__(self, decisions: DataFrame) -> None:
        self.decisions = decisions

    def decide(self, rows: DataFrame, kind: str, inputs: dict[str, Column], out: str, where: Column | None = None) -> DataFrame:
        known = self.decisions.filter(F.col("kind") == kind).select(F.col("input_hash").alias("_h"), F.from_json("payload", SCHEMAS[kind]).alias(out))
        hashed = input_hash(inputs) if where is None else F.when(where, input_hash(inputs))
        return rows.withColumn("_h", hashed).join(known, "_h", "left").drop("_h")


class Rules:
    """Offline stand-ins, all of them column expressions."""

    def decide(self, rows: DataFrame, kind: str, inputs: dict[str, Column], out: str, where: Column | None = None) -> DataFrame:
        fields = getattr(self, kind)(**inputs)
        answer = F.struct(*(v.alias(k) for k, v in fields.items())).cast(_struct(kind))
        return rows.withColumn(out, answer if where is None else F.when(where, answer))

    def clause_match(self, clause: Column) -> dict[str, Column]:
        return {"needs_lookup": F.size(F.split(T.strip(clause), r"\s+")) >= 5}

    def best_match(self, compare_clause: Column, candidates: Column) -> dict[str, Column]:
        """candidates: array of (content, score) in order; the first is taken, with confidence by its score."""
        score = F.get(candidates, F.lit(0))["score"]
        return {"best_index": F.lit(0), "confidence": F.when(score >= 0.8, "High").when(score >= 0.5, "Medium").otherwise("Low")}

    def targeted_context(self, base_text: Column, compare_clause: Column) -> dict[str, Column]:
        return {"snippet": base_text}

    def deviation(self, base_clause: Column, compare_clause: Column) -> dict[str, Column]:
        same = T.collapse(base_clause) == T.collapse(compare_clause)
        kind = F.when(same, "none").when(
            F.length(compare_clause) > F.length(base_clause), "addition"
        ).when(F.length(compare_clause) < F.length(base_clause), "omission").otherwise("modification")
        return {"has_deviation": ~same, "deviation_type": kind}

    def section_label(self, base_clause: Column, compare_clause: Column) -> dict[str, Column]:
        return {"section": F.coalesce(T.section_number(T.first_line(base_clause)), F.lit("N/A"))}

    def comment(self, base_clause: Column, compare_clause: Column, deviation_type: Column, correction_notes: Column) -> dict[str, Column]:
        return {
            "comments": F.concat(deviation_type, F.lit(": "), F.length(base_clause).cast("string"), F.lit(" and "), F.length(compare_clause).cast("string"), F.lit(" characters"))
        }

    def grounding(self, comments: Column, base_clause: Column, compare_clause: Column) -> dict[str, Column]:
        return {"grounded": F.lit(True), "issues": F.lit("")}

    def materiality(self, deviation_type: Column, comments: Column, base_clause: Column, compare_clause: Column) -> dict[str, Column]:
        share = F.abs(F.length(base_clause) - F.length(compare_clause)) / F.greatest(F.length(base_clause), F.length(compare_clause), F.lit(1))
        score = F.least(F.lit(5), F.lit(1) + F.floor(share * 5)).cast("int")
        return {"score": score, "severity": F.when(score >= 4, "High").when(score >= 2, "Medium").otherwise("Low")}

    def field_match(self, field_name: Column, field_value: Column, section_text: Column) -> dict[str, Column]:
        found = F.contains(F.lower(section_text), F.lower(field_value))
        return {"match": found, "reason": F.when(found, "The value occurs in the section.").otherwise("The value does not occur in the section.")}

    def toc(self, preview: Column) -> dict[str, Column]:
        """Most lines begin with a number and end with one."""
        lines = F.filter(F.split(preview, "\n"), lambda x: T.strip(x) != "")
        listed = F.filter(lines, lambda x: x.rlike(r"(?U)^\s*\d+(\.\d+)*\.?\s*\D.*\d\s*$"))
        return {"is_toc": (F.size(lines) >= 3) & (F.size(listed) * 10 >= F.size(lines) * 8)}

    def heading_rank(self, query: Column, headings: Column) -> dict[str, Column]:
        """Indices of the headings that contain the query."""
        at = F.filter(F.transform(headings, lambda h, i: F.when(F.contains(F.lower(h), F.lower(query)), i)), lambda i: i.isNotNull())
        return {"headings": F.slice(at, 1, 3)}

    def pick_best(self, query: Column, candidates: Column) -> dict[str, Column]:
        """The first candidate whose text contains the query; null if none does."""
        at = F.filter(F.transform(candidates, lambda c, i: F.when(F.contains(F.lower(c), F.lower(query)), i)), lambda i: i.isNotNull())
        return {"index": F.get(at, F.lit(0))}

    def whole_comparison(self, base: Column, compare: Column) -> dict[str, Column]:
        """The paragraphs of the compared prompt that the base prompt does not have, as additions."""
        text = lambda p: F.regexp_replace(p, r"^\[\d+\] \(p\.\d+ \| §[^)]*\) ", "")
        known = F.transform(F.split(base, "\n\n"), text)
        fresh = F.filter(F.split(compare, "\n\n"), lambda p: ~F.array_contains(known, text(p)))
        item = lambda p: F.struct(
            F.regexp_extract(p, "§([^)]*)", 1).alias("section"), F.lit(0).alias("base_page"), F.regexp_extract(p, r"p\.(\d+)", 1).cast("int").alias("compare_page"), F.lit("").alias("base_paragraph"), text(p).alias("compare_paragraph"),
            F.lit(True).alias("deviation"), F.lit("not in the base document").alias("comments"),
        )
        return {"items": F.transform(fresh, item)}

    def verify(self, query: Column, text: Column) -> dict[str, Column]:
        return {"verified": F.contains(F.lower(text), F.lower(query)), "output": text}

    def terms(self, statement: Column) -> dict[str, Column]:
        """Runs of words that begin with capitals."""
        return {"terms": F.regexp_extract_all(statement, F.lit(r"(\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+)*)"), F.lit(1))}

    def synthesis(self, statement: Column, context: Column) -> dict[str, Column]:
        return {"output": F.concat(statement, F.lit("\n\n"), context)}

    def retrieve(self, query: Column) -> dict[str, Column]:
        return {"response": F.lit("Yes")}

    def relevance(self, query: Column, context: Column) -> dict[str, Column]:
        words = F.array_distinct(F.split(F.lower(query), r"\s+"))
        shared = F.filter(words, lambda w: (F.length(w) > 3) & F.contains(F.lower(context), w))
        return {"response": F.when(F.size(shared) > 0, "Relevant").otherwise("Irrelevant")}

    def generate(self, query: Column, context: Column) -> dict[str, Column]:
        return {"response": F.substring(context, 1, 200)}

    def support(self, response: Column, context: Column) -> dict[str, Column]:
        return {"response": F.when(F.contains(context, response), "Fully supported").otherwise("No support")}

    def utility(self, query: Column, response: Column) -> dict[str, Column]:
        words = F.array_distinct(F.split(F.lower(query), r"\s+"))
        shared = F.size(F.filter(words, lambda w: F.contains(F.lower(response), w)))
        return {"response": F.least(F.lit(5), F.lit(1) + shared).cast("int")}


def _parts(schema: str) -> list[str]:
    return schema.split(", ") if "<" not in schema else [schema]


def _struct(kind: str) -> str:
    return f"struct<{', '.join(x.replace(' ', ':', 1) for x in _parts(SCHEMAS[kind]))}>"


class Live:
    """Calls function(kind, rows of inputs) for each batch of open rows, which answers with a dict or None for each row.

    calls bounds how many tasks call at once. What leads to the rows is worked out before, by as many tasks as it takes, and
    both it and the answers are durable.
    """

    def __init__(self, function: Callable[[str, list[dict]], list[dict | None]], calls: int = 5) -> None:
        self.function, self.calls = function, calls

    def decide(self, rows: DataFrame, kind: str, inputs: dict[str, Column], out: str, where: Column | None = None) -> DataFrame:
        function, names = self.function, [x.split(" ")[0] for x in _parts(SCHEMAS[kind])]

        @F.pandas_udf(_struct(kind))
        def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                open_ = part.pop("_open").to_numpy(bool)
                told = iter(function(kind, part[open_].to_dict("records")) if open_.any() else [])
                answers = [next(told) if o else None for o in open_.tolist()]
                yield pd.DataFrame([a if a is not None else dict.fromkeys(names) for a in answers], columns=names)

        open_ = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        ready = durable(rows.withColumn("_open", open_).withColumn("_in", F.struct(*(c.alias(k) for k, c in sorted(inputs.items())), "_open")))
        answered = ready.coalesce(self.calls).withColumn(out, ask.asNondeterministic()("_in"))
        # A struct without any answer is null, as with the other deciders.
        nothing = F.lit(True)
        for name in names:
            nothing &= F.col(f"{out}.{name}").isNull()
        return durable(answered).withColumn(out, F.when(~nothing, F.col(out))).drop("_open", "_in")
