"""Tags by a table of many rules: one automaton as a screen, regular expressions for what it lets through."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

MOST_RULES = 10_000  # the table of rules goes to every task


def _screen(literals: list[str | None], text: str):
    """Adds the numbers of the rules whose literal stands in the text; rules without one always stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, by_literal = ahocorasick.Automaton(), {}
        for k, literal in enumerate(literals):
            if literal:
                by_literal.setdefault(literal, []).append(k)
        for literal, numbers in by_literal.items():
            automaton.add_word(literal, numbers)
        always = [k for k, literal in enumerate(literals) if not literal]
        if by_literal:
            automaton.make_automaton()
        for batch in batches:
            found, ends = [], [0]
            for t in pc.ascii_lower(batch.column(text)).to_pylist():
                hits = set(always)
                if t and by_literal:
                    for _, numbers in automaton.iter(t):
                        hits.update(numbers)
                found += sorted(hits)
                ends.append(len(found))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(found, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "_rules"])

    return run


def tag_by_rules(df: DataFrame, rules: DataFrame, text: str, name: str = "rule_tags") -> DataFrame:
    """Add the tags of all rules whose pattern is found in the text, in the order of the rules' tags.

    `rules` has `tag, pattern, literal`, at most MOST_RULES rows. Patterns are Java regular expressions whatever the
    case; `literal` is a text that every match of the pattern contains, in lower case, or null where there is none.
    An automaton over all literals tells which rules a text can fit at all, so the work per text does not grow with
    the number of rules; only those patterns are tried. No row moves. A null text has no tags.
    """
    listed = sorted((r.tag, r.pattern, r.literal) for r in rules.select("tag", "pattern", F.lower("literal").alias("literal")).limit(MOST_RULES + 1).collect())
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not listed:
        return df.withColumn(name, F.array().cast("array<string>"))
    schema = StructType([*df.schema.fields, StructField("_rules", ArrayType(IntegerType()))])
    screened = df.mapInArrow(_screen([r[2] for r in listed], text), schema)
    patterns = F.array(*[F.lit("(?i)" + r[1]) for r in listed])
    tags = F.array(*[F.lit(r[0]) for r in listed])
    fits = F.filter("_rules", lambda k: F.coalesce(F.regexp_like(F.col(f"`{text}`"), F.element_at(patterns, k + 1)), F.lit(False)))
    return screened.withColumn(name, F.array_distinct(F.transform(fits, lambda k: F.element_at(tags, k + 1)))).drop("_rules")
