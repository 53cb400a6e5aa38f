"""From lines to section-aware chunks: Markdown blocks, margins, headings, breadcrumbs, packing, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions.text import clean_title, repeat_key, split_text, strip

LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def lines(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, keep…, line_no from 0, line stripped) of every line; an empty text has none."""
    return docs.where(F.length(text) > 0).select(key, *keep, F.posexplode_outer(F.split(text, LINE_END)).alias("line_no", "line")).withColumn("line", strip("line"))


def markdown_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_index from 0, type, heading, heading_level, content): lines grouped to blocks.

    A blank line ends a block; lines of a table, and other lines, stay together; every heading line is a block
    of its own. The islands are a running count of the lines that open one.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").startswith("|"), "table").when(F.col("line").startswith("#"), "heading").otherwise("text")
    marked = lines(docs, key, text).withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    opens = F.col("before").isNull() | (F.col("kind") == "heading") | (F.col("before") != F.col("kind"))
    islands = marked.where("kind <> 'blank'").withColumn("island", F.sum(F.when(opens, 1).otherwise(0)).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    grouped = islands.groupBy(key, "island").agg(F.first("kind").alias("kind"), body.alias("raw"))
    level = F.length(F.regexp_extract("raw", "^#+", 0))
    heading = F.col("kind") == "heading"
    return grouped.select(
        key, (F.col("island") - 1).cast("int").alias("block_index"), F.when(F.col("kind") == "table", "table").otherwise("text").alias("type"), heading.alias("heading"),
        F.when(heading, F.greatest(F.lit(1), F.least(level, F.lit(6)))).alias("heading_level"), F.when(heading, clean_title("raw")).otherwise(F.col("raw")).alias("content"),
    )


def paged_blocks(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, block_index from 0 within the document, …): the blocks of documents that come as one Markdown text a page.

    Lines that stand at the ends of several pages of a document, its running heads and feet, go wherever they stand, before blocks are made.
    """
    noisy = repeated_lines(pages, doc, page, text)
    rows = lines(pages, page, text, doc).withColumn("line_key", repeat_key("line"))
    kept = rows.join(noisy.select(doc, "line_key"), [doc, "line_key"], "left_anti")
    whole = kept.groupBy(doc, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_t"))
    out = markdown_blocks(whole.select(F.struct(doc, page).alias("_k"), "_t"), "_k", "_t").select(f"_k.{doc}", f"_k.{page}", "*").drop("_k")
    order = Window.partitionBy(doc).orderBy(page, "block_index")
    return out.withColumn("block_index", (F.row_number().over(order) - 1).cast("int"))


def repeated_lines(pages: DataFrame, group: str, page: str, text: str, head: int = 2, tail: int = 4, least: int = P.REPEATS) -> DataFrame:
    """(group, line_key, pages): normalized lines among the first and last of a page that stand so on several pages of their group."""
    rows = lines(pages, page, text, group).where("line <> ''")
    up, down = Window.partitionBy(group, page).orderBy("line_no"), Window.partitionBy(group, page).orderBy(F.desc("line_no"))
    ends = rows.withColumn("a", F.row_number().over(up)).withColumn("z", F.row_number().over(down)).where((F.col("a") <= head) | (F.col("z") <= tail))
    keyed = ends.select(group, page, repeat_key("line").alias("line_key")).where("line_key <> ''").distinct()
    return keyed.groupBy(group, "line_key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)


def repeated_margins(blocks: DataFrame, group: str, text: str, margin: str, least: int = P.REPEATS) -> DataFrame:
    """blocks without those whose normalized text repeats as a margin block; also blocks in the body with such a text go."""
    keyed = blocks.withColumn("_key", repeat_key(text))
    often = keyed.where(F.col(margin) & (F.col("_key") != "")).groupBy(group, "_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    same = F.col("k._key") == F.col("o._key")
    return keyed.alias("k").join(often.alias("o"), same & F.col(f"k.{group}").eqNullSafe(F.col(f"o.{group}")), "left_anti").drop("_key")


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    """Whether a box of some height lies in the upper or lower margin of a page."""
    return (y1 - y0 > 0) & (height > 0) & ((y0 < P.MARGIN_RATIO * height) | (y1 > (1 - P.MARGIN_RATIO) * height))


# ---- headings ---------------------------------------------------------------------------------------------------------
def body_sizes(blocks: DataFrame, key: str) -> DataFrame:
    """(key, body_size): the size most characters of longer text blocks have; the first seen of equals, 0 if there are none."""
    body = strip("content")
    counted = blocks.where((F.col("type") == "text") & (F.coalesce("size", F.lit(0.0)) != 0) & (F.length(body) >= P.BODY_SAMPLE_CHARS))
    sums = counted.groupBy(key, F.round("size", 1).alias("s")).agg(F.sum(F.length(body)).alias("n"), F.min("block_index").alias("first"))
    best = sums.groupBy(key).agg(F.max_by("s", F.struct("n", (-F.col("first")).alias("f"))).alias("body_size"))
    return blocks.select(key).distinct().join(best, key, "left").select(key, F.coalesce("body_size", F.lit(0.0)).alias("body_size"))


def heading_levels(blocks: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, size, level): heading sizes from large to small as levels 1, 2, 3…"""
    body = strip("content")
    styled = F.coalesce(F.col("style").rlike(P.HEADING_STYLE), F.lit(False))
    big = (
        blocks.where((F.col("type") == "text") & (body != "") & (F.length(body) <= P.HEADING_CHARS) & ~styled).join(sizes, key)
        .where((F.col("body_size") > 0) & (F.col("size") >= F.col("body_size") * P.HEADING_RATIO)).select(key, F.round("size", 1).alias("size")).distinct()
    )
    return big.withColumn("level", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("size"))))


def with_headings(blocks: DataFrame, key: str) -> DataFrame:
    """blocks(key, block_index, type, content, size, bold, style, heading, heading_level) with is_heading and level.

    The document's statistics are one small row each, joined back on the document.
    """
    sizes = body_sizes(blocks, key)
    levels = heading_levels(blocks, sizes, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("size").cast("string"), "level"))).alias("levels"))
    rows = blocks.join(sizes, key).join(levels, key, "left")
    body = strip("content")
    size = F.coalesce("size", F.lit(0.0))
    by_size = F.element_at("levels", F.round(size, 1).cast("string"))
    known = F.element_at("levels", size.cast("double").cast("string")).isNotNull()
    styled = F.coalesce(F.col("style").rlike(P.HEADING_STYLE), F.lit(False))
    is_heading = (
        F.when((F.col("type") != "text") | (body == "") | (F.length(body) > P.HEADING_CHARS), False)
        .when(F.coalesce("heading", F.lit(False)), ~body.rlike(P.CAPTION)).when(body.rlike(P.CAPTION), False).when(styled, True)
        .when((size == 0) | (F.col("body_size") == 0), False).when((size >= F.col("body_size") * P.HEADING_RATIO) & known, True)
        .otherwise(F.coalesce("bold", F.lit(False)) & (F.length(body) <= 40) & (size >= F.col("body_size")))
    )
    level = F.coalesce(
        F.when(F.col("heading_level") != 0, F.greatest(F.lit(1), F.least(F.col("heading_level"), F.lit(6)))),
        F.when(styled, F.regexp_extract("style", P.HEADING_STYLE, 1).cast("int")), by_size, F.lit(1),
    )
    return rows.withColumn("is_heading", F.coalesce(is_heading, F.lit(False))).withColumn("level", level).drop("levels")


_STATE = "struct<crumbs:array<struct<level:int,title:string>>,section:int,buf:array<string>,n:int,type:string,page:int,context:string,index:int,out:array<struct<section:int,crumb:string,type:string,page:int,context:string,index:int,body:string>>>"


def packed(blocks: DataFrame, key: str) -> DataFrame:
    """(key, buffer_no, section, crumb, type, page, context, block_index, body): blocks packed under their headings.

    blocks come from with_headings, with page and context. One fold over a document's blocks in order keeps the
    stack of the last three headings and the open buffer; a heading, a figure, a table, another page or type, or a
    buffer that would pass the chunk size closes it. Each document is one row, so the fold is one task's work per document.
    """
    title = F.regexp_extract(strip("content"), r"\A[^\n\r]*", 0)
    row = F.struct("block_index", "is_heading", F.col("level").cast("int").alias("level"), strip(title).alias("title"), "type", "page", strip(F.coalesce("content", F.lit(""))).alias("body"), strip(F.coalesce("context", F.lit(""))).alias("context"))
    docs = blocks.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("b"))
    size = P.CHUNK_SIZE
    fold = f"""aggregate(b, cast(named_struct('crumbs', array(), 'section', 0, 'buf', array(), 'n', 0, 'type', 'text', 'page', null, 'context', '', 'index', 0, 'out', array()) as {_STATE}), (a, x) ->
      case when x.is_heading then
        named_struct('crumbs', concat(slice(filter(a.crumbs, c -> c.level < x.level), if(size(filter(a.crumbs, c -> c.level < x.level)) > 2, 2, 1), 3), array(named_struct('level', x.level, 'title', x.title))),
          'section', a.section + 1, 'buf', cast(array() as array<string>), 'n', 0, 'type', a.type, 'page', a.page, 'context', a.context, 'index', a.index, 'out', {_closed('a')})
      when x.type = 'figure' and x.context = '' then
        named_struct('crumbs', a.crumbs, 'section', a.section, 'buf', cast(array() as array<string>), 'n', 0, 'type', a.type, 'page', a.page, 'context', a.context, 'index', a.index, 'out', {_closed('a')})
      else aggregate(array(struct(if(x.type = 'figure', concat('{P.FIGURE_PREFIX}', x.context), x.body) as body)), a, (s, y) ->
        case when size(s.buf) > 0 and not (x.type in ('figure', 'table') or not (x.page <=> s.page) or s.type <> x.type or s.n + length(y.body) > {size}) then
          {_maybe('s.crumbs', 's.section', 'concat(s.buf, array(y.body))', 's.n + length(y.body)', 's.type', 's.page', 's.context', 's.index', 's.out', size)}
        else
          {_maybe('s.crumbs', 's.section', 'array(y.body)', 'length(y.body)', 'x.type', 'x.page', 'x.context', 'x.block_index', _closed('s'), size)}
        end)
      end, a -> {_closed('a')})"""
    # explode_outer: a plain explode would make the optimizer run the fold again in a filter on its size
    rows = docs.select(key, F.posexplode_outer(F.expr(fold)).alias("buffer_no", "x")).where("x is not null")
    return rows.select(key, "buffer_no", "x.section", "x.crumb", "x.type", "x.page", "x.context", F.col("x.index").alias("block_index"), "x.body")


def _crumb(a: str) -> str:
    return f"array_join(transform({a}.crumbs, c -> c.title), ' > ')"


def _closed(a: str) -> str:
    """The finished buffers of a state with its open one."""
    return f"if(size({a}.buf) = 0, {a}.out, concat({a}.out, array(named_struct('section', {a}.section, 'crumb', {_crumb(a)}, 'type', {a}.type, 'page', {a}.page, 'context', {a}.context, 'index', {a}.index, 'body', array_join({a}.buf, '\\n')))))"


def _maybe(crumbs: str, section: str, buf: str, n: str, kind: str, page: str, context: str, index: str, out: str, size: int) -> str:
    """The next state; a buffer that has reached the chunk size is closed at once."""
    one = f"named_struct('section', {section}, 'crumb', {_crumb(crumbs.removesuffix('.crumbs'))}, 'type', {kind}, 'page', {page}, 'context', {context}, 'index', {index}, 'body', array_join({buf}, '\\n'))"
    tail = f"'type', {kind}, 'page', {page}, 'context', {context}, 'index', {index}"
    return f"if({n} >= {size}, named_struct('crumbs', {crumbs}, 'section', {section}, 'buf', cast(array() as array<string>), 'n', 0, {tail}, 'out', concat({out}, array({one}))), named_struct('crumbs', {crumbs}, 'section', {section}, 'buf', {buf}, 'n', {n}, {tail}, 'out', {out}))"


def chunks(buffers: DataFrame, key: str) -> DataFrame:
    """(chunk_id, key, chunk_no, section, section_id, type, page, content): buffers split at sentence ends, each piece under its breadcrumb."""
    body = buffers.withColumn("body", strip("body")).where(F.length("body") >= P.CHUNK_LEAST)
    pieces = body.select(key, "buffer_no", "section", "crumb", "type", "page", F.posexplode_outer(split_text("body")).alias("piece_no", "piece")).where("piece is not null")
    w = Window.partitionBy(key).orderBy("buffer_no", "piece_no")
    name = F.col(key).cast("string")
    return pieces.withColumn("chunk_no", F.row_number().over(w) - 1).select(
        F.concat(name, F.lit("-"), F.lpad(F.col("chunk_no").cast("string"), 4, "0")).alias("chunk_id"), key, "chunk_no", F.col("crumb").alias("section"),
        F.when(F.col("section") > 0, F.concat(name, F.lit("#s"), F.lpad(F.col("section").cast("string"), 3, "0"))).otherwise("").alias("section_id"), "type", "page",
        F.when(F.col("crumb") != "", F.concat(F.lit(P.SECTION_PREFIX), "crumb", F.lit("\n"), "piece")).otherwise(F.col("piece")).alias("content"),
    )


# ---- layout -----------------------------------------------------------------------------------------------------------
def box_distance(a: str, b: str) -> Column:
    """Distance of two boxes [x0, y0, x1, y1], 0 if they touch; null if one is missing."""
    dx = F.greatest(F.lit(0.0), F.greatest(F.col(b)[0] - F.col(a)[2], F.col(a)[0] - F.col(b)[2]))
    dy = F.greatest(F.lit(0.0), F.greatest(F.col(b)[1] - F.col(a)[3], F.col(a)[1] - F.col(b)[3]))
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.sqrt(dx * dx + dy * dy))


def intersects(a: str, b: str) -> Column:
    return (F.col(a)[0] < F.col(b)[2]) & (F.col(b)[0] < F.col(a)[2]) & (F.col(a)[1] < F.col(b)[3]) & (F.col(b)[1] < F.col(a)[3])


def outside_tables(blocks: DataFrame, key: str) -> DataFrame:
    """Text blocks that no table of their page overlaps."""
    tables = blocks.where("type = 'table'").select(F.col(key).alias("_d"), F.col("page").alias("_p"), F.col("bbox").alias("_box"))
    return blocks.where("type = 'text'").join(tables, (F.col(key) == F.col("_d")) & (F.col("page") == F.col("_p")) & intersects("bbox", "_box"), "left_anti")


def nearest_text(blocks: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, block_index, context): for each figure the k nearest text blocks of its page, in order of distance.

    Without boxes the distance is a thousand for each block between. The join is on document and page, so it stays within a page.
    """
    near = _near(blocks, key, F.col("type") == "text")
    w = Window.partitionBy(key, "block_index").orderBy("distance", "other")
    picked = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).where(F.col("content") != "")
    joined = picked.groupBy(key, "block_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", strip("content").alias("c")))), lambda x: x["c"]), " ").alias("context"))
    return blocks.where("type = 'figure'").select(key, "block_index").join(joined, [key, "block_index"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def nearest_caption(blocks: DataFrame, key: str) -> DataFrame:
    """(key, block_index, caption): for each figure the nearest text of its page that reads as a caption, empty if there is none."""
    near = _near(blocks, key, (F.col("type") == "text") & strip("content").rlike(P.FIGURE_CAPTION), 0.0)
    best = near.groupBy(key, "block_index").agg(F.min_by(strip("content"), F.struct("distance", "other")).alias("caption"))
    return blocks.where("type = 'figure'").select(key, "block_index").join(best, [key, "block_index"], "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def _near(blocks: DataFrame, key: str, which: Column, without_box: float | None = None) -> DataFrame:
    figures = blocks.where("type = 'figure'").select(key, "page", "block_index", F.col("bbox").alias("fbox"))
    texts = blocks.where(which).select(key, "page", F.col("block_index").alias("other"), F.col("bbox").alias("tbox"), "content")
    gap = F.abs(F.col("other") - F.col("block_index")) * 1000.0 if without_box is None else F.lit(without_box)
    return figures.join(texts, [key, "page"]).withColumn("distance", F.coalesce(box_distance("fbox", "tbox"), gap))
