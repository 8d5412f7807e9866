"""Spans and evidence: overlap and containment, coverage sweeps, greedy context packing, citations, claim tiling, hydration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trusted_url
from ..sources.shared import dealt, fewer


#: Cited sources that are sent to tasks; more are met by a join.
SENT = 500_000
#: Bytes of text whose lines are made at once.
LINE_BYTES = 4 << 20


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of ids and texts in slices of some ``LINE_BYTES`` of text, or of one text that is longer."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    group = np.cumsum(size) // LINE_BYTES
    bounds = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(size)]
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield batch.slice(a, z - a)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id, line_no, start, stop, line): lines with their UTF-8 byte ranges, line ends left out; a null text is one empty line.

    No shuffle, and work in proportion to the text: some megabytes of an Arrow batch are split at once and sizes are summed over all
    their lines. Without ``texts`` the lines themselves are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches if whole.num_rows for piece in _pieces(whole)):
            parts = pc.split_pattern(pc.fill_null(batch.column(1).cast(pa.large_string()), ""), "\n")
            rows, line = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)
            size = pc.binary_length(line).to_numpy().astype(np.int64)
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            begin = np.cumsum(size + 1) - size - 1
            start = begin - begin[first][rows]
            number = np.arange(len(rows)) - first[rows]
            columns = [batch.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(start), pa.array(start + size)] + ([line.cast(pa.string())] if texts else [])
            yield pa.RecordBatch.from_arrays(columns, [id_col, "line_no", "start", "stop", *(["line"] if texts else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, line_no int, start long, stop long" + (", line string" if texts else ""))


def _cells(df: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    """A row for each cell of ``width`` bytes that a range reaches into; an empty range is in the cell of its start."""
    last = f"greatest({start}, {stop} - 1) div {width}"
    return df.withColumn("__cell", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(last))))


def overlaps(left: DataFrame, right: DataFrame, artifact: str, width: int = 1024) -> DataFrame:
    """Pairs of ranges of one artifact that overlap by a byte at least, each once.

    ``left`` has a_start, a_stop, ``right`` b_start, b_stop. Ranges are cut into cells of ``width`` bytes and joined by (artifact, cell),
    so a long artifact with very many ranges is no single key; a pair counts in the cell where its overlap begins.
    """
    a = _cells(left, "a_start", "a_stop", width)
    b = _cells(right, "b_start", "b_stop", width)
    begins = F.expr(f"greatest(a_start, b_start) div {width}")
    return a.join(b, [artifact, "__cell"]).where((F.col("a_start") < F.col("b_stop")) & (F.col("a_stop") > F.col("b_start")) & (F.col("__cell") == begins)).drop("__cell")


def contained(inner: DataFrame, outer: DataFrame, artifact: str, width: int = 1024) -> DataFrame:
    """Pairs where the b range lies within the a range."""
    found = overlaps(outer, inner, artifact, width)
    return found.where((F.col("b_start") >= F.col("a_start")) & (F.col("b_stop") <= F.col("a_stop")))


def coverage(spans: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, covered_to, complete): how far sorted parts cover a span without a gap.

    ``spans``: start, stop; ``parts``: p_start, p_stop. A part counts if no gap opens before it: its start is not after the
    latest end of the parts before it.
    """
    rows = parts.join(spans, key).where(F.col("p_stop") > F.col("start"))
    before = F.expr(f"max(p_stop) OVER (PARTITION BY {key} ORDER BY p_start, p_stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    gap = (F.col("p_start") > F.greatest(F.coalesce("before", "start"), F.col("start"))).cast("int")
    rows = rows.withColumn("before", before).withColumn("gap", gap)
    rows = rows.withColumn("broken", F.expr(f"max(gap) OVER (PARTITION BY {key} ORDER BY p_start, p_stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    ends = rows.where("broken = 0").groupBy(key).agg(F.max("p_stop").alias("upto"))
    out = spans.join(ends, key, "left").withColumn("covered_to", F.least(F.coalesce("upto", "start"), F.col("stop")))
    return out.select(key, "covered_to", (F.col("covered_to") >= F.col("stop")).alias("complete"))


def pack(items: DataFrame, part: str, order: str, tokens: str, budget: int) -> DataFrame:
    """(part, order, packed, total): greedy packing in order; an item that would exceed the budget is left out and the next is tried.

    One fold over a question's items, which are bounded by its ranked list; ``total`` is the tokens packed up to there.
    """
    kind = dict(items.dtypes)[order]
    rows = items.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("t")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.expr(f"cast(array() as array<struct<o:{kind},packed:boolean,total:bigint>>)").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        fits = acc["total"] + row["t"] <= budget
        total = acc["total"] + F.when(fits, row["t"]).otherwise(F.lit(0))
        return F.struct(total.alias("total"), F.concat(acc["out"], F.array(F.struct(row["o"].alias("o"), fits.alias("packed"), total.alias("total")))).alias("out"))

    folded = rows.select(part, F.explode(F.aggregate("rows", start, step)["out"]).alias("x"))
    return folded.select(part, F.col("x.o").alias(order), F.col("x.packed").alias("packed"), F.col("x.total").alias("total"))


def render_block(evidence_id: Column, versions: Column, status: Column, text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.concat(F.lit("Evidence "), evidence_id.cast("string"), F.lit(" versions ["), F.array_join(versions, ","), F.lit("] status_at_knowledge_snapshot ["), status, F.lit("] text "), quoted)


def tiling(claims: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, n_overlaps, n_gaps): claims (start, stop, in characters) must follow each other with white space alone between them.

    A text meets the sorted array of its claims, so it moves once, however many claims it has.
    """
    own = claims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__claims"))
    rows = own.join(texts.select(key, F.coalesce("text", F.lit("")).alias("__text")), key)

    def prev(i: Column) -> Column:
        return F.when(i > 0, F.get("__claims", i - 1)["stop"]).otherwise(F.lit(0))

    overlaps = F.transform("__claims", lambda c, i: (c["start"] < prev(i)).cast("long"))
    between = F.transform("__claims", lambda c, i: F.substring("__text", prev(i) + 1, F.greatest(c["start"] - prev(i), F.lit(0))).rlike(r"\S").cast("long"))
    tail = F.substring("__text", F.element_at("__claims", -1)["stop"] + 1, F.length("__text")).rlike(r"\S")
    last = F.element_at("between", -1)

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)

    rows = rows.select(key, overlaps.alias("overlaps"), between.alias("between"), tail.alias("tail"))
    # The last claim has a gap before it or after it, and counts once.
    gaps = total("between") + F.when(F.col("tail") & (last == 0), 1).otherwise(0)
    return rows.select(key, total("overlaps").alias("n_overlaps"), gaps.cast("long").alias("n_gaps"))


def cite(claims: DataFrame, sources: DataFrame, cap: int, claim: str = "claim_id") -> DataFrame:
    """(claim, source_id, n, url, span_start, span_stop): sources of each claim in order, ``cap`` at most.

    ``claims``: (claim, source_id, start, stop). Only sources with a trusted URL are cited. The span is given only where a claim
    has a single source: its first that isn't empty. Of the sources those that are asked for are sent to tasks, unless they are many:
    few sources of many claims would be as many tasks of a join. Claims are dealt out once, before they are grouped.
    """
    asked = claims.select("source_id").distinct()
    cited = fewer(sources.where(trusted_url("url")).select("source_id", "url").join(asked, "source_id", "left_semi"), SENT, "sources")
    good = dealt(claims.join(cited, "source_id"), claim)
    first = F.min(F.when(F.col("stop") > F.col("start"), F.struct("start", "stop"))).alias("span")
    per = good.groupBy(claim, "source_id", "url").agg(first)
    per = per.withColumn("n", F.expr(f"row_number() OVER (PARTITION BY {claim} ORDER BY source_id)")).withColumn("of", F.expr(f"count(*) OVER (PARTITION BY {claim})"))
    single = F.col("of") == 1
    return per.where(F.col("n") <= cap).select(claim, "source_id", "n", "url", F.when(single, F.col("span.start")).alias("span_start"), F.when(single, F.col("span.stop")).alias("span_stop"))


def hydrate(hits: DataFrame, records: DataFrame, texts: DataFrame, key: str = "key") -> DataFrame:
    """Every hit with its text and a state: COMPLETE, MISSING_TEXT or MISSING_RECORD. No hit vanishes."""
    j = hits.join(records.withColumn("__r", F.lit(True)), key, "left").join(texts.withColumn("__t", F.lit(True)), key, "left")
    state = F.when(F.col("__r").isNull(), "MISSING_RECORD").when(F.col("__t").isNull(), "MISSING_TEXT").otherwise("COMPLETE")
    return j.withColumn("state", state).drop("__r", "__t")


def provenance(chunks: DataFrame, versions: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """(chunk, n_versions, n_sources): chunk to versions to sources, distinct.

    Rows are dealt out by version, then by chunk, and grouped once: a chunk's distinct ids are no more than its own array holds.
    """
    asked = chunks.select(chunk, F.explode(F.array_distinct("version_ids")).alias("version_id"))
    rows = dealt(asked.join(dealt(versions.select("version_id", "source_id"), "version_id"), "version_id"), chunk)
    return rows.groupBy(chunk).agg(*(F.size(F.collect_set(f"{c}_id")).cast("long").alias(f"n_{c}s") for c in ("version", "source")))


def account(hits: DataFrame, kept: DataFrame, rejected: DataFrame, key: str = "key") -> DataFrame:
    """(key, issue) where kept and rejected don't add up to the hits: LOST, TWICE or UNKNOWN. Empty if they do."""
    rows = hits.select(key, F.lit(1).alias("h"), F.lit(0).alias("o")).unionByName(kept.select(key, F.lit(0).alias("h"), F.lit(1).alias("o"))).unionByName(rejected.select(key, F.lit(0).alias("h"), F.lit(1).alias("o")))
    sums = rows.groupBy(key).agg(F.sum("h").alias("h"), F.sum("o").alias("o"))
    issue = F.when(F.col("h") == 0, "UNKNOWN").when(F.col("o") == 0, "LOST").when(F.col("o") > F.col("h"), "TWICE")
    return sums.select(key, issue.alias("issue")).where("issue IS NOT NULL")
