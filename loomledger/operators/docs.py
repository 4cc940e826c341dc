"""Document operators: section trees, section matches, ranked search, paging, section text."""

from __future__ import annotations

import base64
import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strength of a match: the smaller, the stronger.
STRENGTH = {"exact": 0, "folder": 1, "file": 2, "header": 3, "body": 4}


def doc_lines(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line (from 0) and content; an empty last line doesn't count."""
    lines = docs.select(F.col(path).alias("path"), F.posexplode(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")).alias("line", "content"))
    return lines


def headers(lines: DataFrame) -> DataFrame:
    """path, line, level, title and fenced of every header line; fences toggle, so a line inside has an odd number of them before it."""
    fence = F.col("content").rlike(r"^\s{0,3}(```|~~~)")
    before = F.sum(fence.cast("int")).over(Window.partitionBy("path").orderBy("line"))
    hit = lines.withColumn("fenced", (before % 2 == 1)).withColumn("_m", F.regexp_extract("content", r"^(#{1,6})\s+(.*?)\s*$", 1))
    return hit.where((F.col("_m") != "") & ~fence).select("path", "line", F.length("_m").alias("level"), F.regexp_extract("content", r"^(#{1,6})\s+(.*?)\s*$", 2).alias("title"), "fenced")


def sections(lines: DataFrame) -> DataFrame:
    """path, address, level, depth, title, start_line (from 1), end_line, line_count of every section.

    The first header is the document's title. Addresses number siblings (1, 1-2); a section named definition has the
    address of that name and no number. Only header rows reach Python, sorted by document and line, of which a task holds a batch and the open document: the stack of levels
    is sequential."""
    ends = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    rows = headers(lines).where("not fenced").join(ends, "path").select("path", "line", "level", "title", "n")
    names = ["path", "address", "level", "depth", "title", "start_line", "end_line", "line_count"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        path, seen, last = None, False, 0
        stack, siblings, out = [], {}, []

        def end(row: list, line: int) -> None:
            row += [line, line - row[-1] + 1]

        for batch in batches:
            for p, line, level, title, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not seen or p != path:
                    for _, _, row in stack:
                        end(row, last)
                    path, seen, last = p, True, n
                    stack, siblings = [], {}
                    continue
                while stack and stack[-1][0] >= level:
                    end(stack.pop()[2], line)
                above = stack[-1][1] if stack else ""
                if title == "definition":
                    address = "definition"
                else:
                    siblings[above] = siblings.get(above, 0) + 1
                    address = f"{above}-{siblings[above]}" if above else str(siblings[above])
                    head, _, rest = title.partition(" ")
                    if head.replace("-", "").isdigit():
                        title = rest
                row = [p, address, level, address.count("-"), title, line + 1]
                stack.append((level, address, row))
                out.append(row)
            # Sections still open wait for their end.
            open_rows = {id(row) for _, _, row in stack}
            done, out = [r for r in out if id(r) not in open_rows], [r for r in out if id(r) in open_rows]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        for _, _, row in stack:
            end(row, last)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.repartition("path").sortWithinPartitions("path", "line").mapInArrow(run, "path string, address string, level int, depth int, title string, start_line int, end_line int, line_count int")


def section_matches(lines: DataFrame, found: DataFrame, query: str, snippets: int = 2) -> DataFrame:
    """path, address (all: no section), strength (header or body) and up to two snippets of every section that holds a query. found: sections."""
    starts = found.select(F.col("path").alias("_p"), F.col("start_line").alias("_s"), "address", "title")
    owned = lines.join(starts, (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_s") - 1), "left").drop("_p")
    order = Window.partitionBy("path").orderBy("line")
    owned = owned.withColumn("owner", F.coalesce(F.last("address", ignorenulls=True).over(order), F.lit("all")))
    hit = owned.where(F.lower("content").contains(query.lower())).withColumn("kind", F.when(F.col("_s").isNotNull(), STRENGTH["header"]).otherwise(STRENGTH["body"]))
    rank = F.row_number().over(Window.partitionBy("path", "owner", "kind").orderBy("line"))
    cut = F.when((F.col("kind") == STRENGTH["body"]) & (rank <= snippets), F.struct("line", F.trim("content").alias("content")))
    hit = hit.withColumn("_snippet", cut)
    return hit.groupBy("path", F.col("owner").alias("address")).agg(F.min("kind").alias("strength"), F.transform(F.array_sort(F.collect_list("_snippet")), lambda s: s["content"]).alias("snippets"))


def search_docs(docs: DataFrame, queries: DataFrame, sort: str = "relevance", scope: str | None = None, limit: int | None = None) -> DataFrame:
    """path, strength, matched (queries), modified of documents that hold any of the queries (columns query, alias), strongest first.

    docs: path, folder, file_name, title, text, modified, and for the sorts of these names created, lines and sections, which then come along.
    sort: relevance, alphabetical, modified, created, lines or sections, the latter four largest first. A direct match outranks an
    alias; ties go to the newest, then by path."""
    from loomledger.operators.ledger import filter_scope

    base = docs if scope is None else filter_scope(docs, "path", scope)
    q = F.lower("query")
    stem = F.regexp_replace(F.lower("file_name"), r"\.md$", "")
    folders = F.split(F.lower("folder"), "/")
    strength = (
        F.when((stem == q) | F.array_contains(folders, q), STRENGTH["exact"])
        .when(F.contains(F.lower("folder"), q), STRENGTH["folder"])
        .when(F.contains(F.lower("file_name"), q), STRENGTH["file"])
        .when(F.contains(F.lower("title"), q), STRENGTH["header"])
        .when(F.contains(F.lower("text"), q), STRENGTH["body"])
    )
    # A handful of queries against all documents: the small side is the query list, which its writer bounds.
    hits = base.join(queries, F.contains(F.lower(F.concat_ws("\n", "folder", "file_name", "title", "text")), q)).withColumn("strength", strength).where("strength is not null")
    more = [sort] if sort in ("created", "lines", "sections") else []
    best = hits.groupBy("path", "modified", *more).agg(F.min(F.struct(F.col("alias").cast("int").alias("a"), F.col("strength").alias("s"))).alias("_b"), F.array_sort(F.collect_set("query")).alias("matched"))
    out = best.select("path", "modified", F.col("_b.s").alias("strength"), (F.col("_b.a") == 1).alias("alias"), "matched", *more)
    orders = {"relevance": ["alias", "strength", F.desc("modified"), "path"], "alphabetical": ["path"], **{c: [F.desc(c), "path"] for c in ("modified", "created", "lines", "sections")}}
    ordered = out.orderBy(*orders[sort])
    return ordered if limit is None else ordered.limit(limit)


def page(df: DataFrame, order: list[str], limit: int, conditions: dict, cursor: str | None = None) -> tuple[DataFrame, callable]:
    """(rows, cursor_of): the next limit rows after a cursor, in the order of columns (ascending, unique together).

    A cursor is bound to a fingerprint of the search's conditions; one of another search is an error. cursor_of makes the
    cursor after a row."""
    mark = hashlib.sha256(json.dumps([conditions, order], sort_keys=True, default=str).encode()).hexdigest()[:16]
    out = df
    if cursor is not None:
        try:
            state = json.loads(base64.urlsafe_b64decode(cursor))
        except ValueError as e:
            raise ValueError("not a cursor") from e
        if state["mark"] != mark:
            raise ValueError("the cursor belongs to another search")
        after: Column = None
        for i, c in enumerate(order):
            step = F.col(c) > F.lit(state["last"][i])
            for j in range(i):
                step = (F.col(order[j]) == F.lit(state["last"][j])) & step
            after = step if after is None else after | step
        out = out.where(after)
    return out.orderBy(*order).limit(limit), lambda row: base64.urlsafe_b64encode(json.dumps({"mark": mark, "last": [row[c] for c in order]}).encode()).decode()


def section_text(lines: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """ord, path, address and text of asked sections (ids: ord, path, address): their lines, without blank and anchor lines at the end."""
    wanted = ids.join(found, ["path", "address"]).select("ord", "path", "address", "start_line", "end_line")
    inside = lines.select(F.col("path").alias("_p"), "line", "content").join(wanted, (F.col("_p") == F.col("path")) & (F.col("line") >= F.col("start_line") - 1) & (F.col("line") < F.col("end_line")))
    empty = F.col("content").rlike(r"^\s*(<a [^>]*></a>)?\s*$")
    last = F.max(F.when(~empty, F.col("line"))).over(Window.partitionBy("ord", "path", "address"))
    kept = inside.withColumn("_last", last).where("line <= _last")
    return kept.groupBy("ord", "path", "address").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("text"))
