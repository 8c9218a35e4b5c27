"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens are its words between blanks. Tokens with a digit, an @ or a slash are variable from the start and
become <*>. The tree has a fixed depth: a line's leaf is its number of tokens and its `depth` leading tokens.
In a leaf that holds different lines, a token is a constant of its place if at least `node_share` of the leaf's
occurrences (a line in a document counts once) have it there, and as many as a template needs to recur; any other is a
variable field, whether its values repeat or not. Lines with the same constants and fields share a template, if
constants make up at least `constant_share` of its tokens. Other lines are a template of their own: by their masked
tokens if as large a share of them is constant, else by their exact text.

A template recurs if lines of at least `min_docs` documents have it; templates of fewer than `long_tokens` tokens must
occur in `short_docs` documents, and lines of fewer than `min_tokens` tokens, which count by their exact text, in
`tiny_docs`. All lines of a recurring template are dropped but those of its first document (smallest doc_id), so that
nothing is lost from the corpus as a whole.

Defined results: null text stays null and has no lines; blank lines are left alone; texts are handled whole, however
long; rows that are equal in doc_id and text are one document and stay equal; rows of the same doc_id and different text
are different documents; null doc_ids come last. Of equally small doc_ids the smaller hash of id and text keeps the lines.
An empty table gives no rows. Extra columns are kept, but for n_lines and n_dropped, which the results replace.

Hot templates: counts are combined before the shuffle, and joins to lines are on narrow rows (a document's key,
a place and hashes) whose hot keys are broadcast, their number being bounded by their share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEPTH, MIN_TOKENS, LONG_TOKENS, MIN_DOCS, SHORT_DOCS, TINY_DOCS, CONSTANT_SHARE, NODE_SHARE = 4, 3, 10, 2, 5, 100, 0.7, 0.1
#: Leaves with different lines up to which their table (8 bytes each) is broadcast.
BROADCAST_LEAVES = 500_000


def tidied(line: Column) -> Column:
    """Single blanks between tokens and none around them."""
    odd = line.rlike(r"[\t\r\x0b\f]") | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.btrim(F.regexp_replace(line, r"[ \t\r\x0b\f]+", " "))).otherwise(line)


def masked(tidy: Column) -> Column:
    """Variable tokens as <*>; one look at a class of characters tells the lines that have any."""
    return F.when(tidy.rlike("[0-9@/]"), F.regexp_replace(tidy, "[^ ]*[0-9@/][^ ]*", "<*>")).otherwise(tidy)


def removed(text: Column, what: str) -> Column:
    """Bytes of `what` in text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))


def tokens_in(text: Column) -> Column:
    return removed(text, " ") + 1


def lines_of(df: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """doc_id, row_key, at, n, leaf, line, exact, fixed, form: all lines that aren't blank; form is the masked text."""
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # per document first: above the explosion its key and text would be computed and kept for every line
    forms = F.transform(F.transform(F.split("text", "\n"), tidied), lambda t: F.struct(F.xxhash64(t).alias("exact"), masked(t).alias("form"), tokens_in(t).alias("n")))
    d = d.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), forms.alias("lines"))
    d = d.select("doc_id", "row_key", F.posexplode("lines").alias("at", "own")).select("doc_id", "row_key", "at", "own.form", "own.n", "own.exact").where(F.col("form") != "")
    fields = F.when(F.contains("form", F.lit("<*>")), removed(F.col("form"), "<*>") / 3).otherwise(0)
    return d.select("doc_id", "row_key", "at", "n", F.xxhash64("n", F.substring_index("form", " ", depth)).alias("leaf"), F.xxhash64("form").alias("line"), "exact", (F.col("n") - fields).alias("fixed"), "form")


def templates(lines: DataFrame, with_form: DataFrame, needed: Column, constant_share: float, node_share: float) -> DataFrame:
    """leaf, line, template: for lines of leaves that hold several, the template by constants and fields."""
    kinds = lines.groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.min("row_key").alias("c"), F.max("row_key").alias("d"), F.count(F.lit(1)).alias("rows"))
    mixed = common.stored(kinds.where("a <> b and c <> d").select("leaf", "rows", F.lit(True).alias("mixed")), "mixed-leaves")
    few = mixed.count() <= BROADCAST_LEAVES
    total = mixed.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def of_mixed(t: DataFrame) -> DataFrame:
        return t.join(F.broadcast(mixed), "leaf", "left_semi") if few else common.hot_split(t, mixed, ["leaf"], ["mixed"], total).where("mixed").drop("mixed")

    held = of_mixed(lines.select("leaf", "line", "row_key")).distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"))
    forms = of_mixed(with_form.select("leaf", "line", "n", "form")).groupBy("leaf", "line").agg(F.first("form").alias("form"), F.first("n").alias("n"))
    own = common.stored(forms.join(held, ["leaf", "line"]), "mixed-lines")
    nodes = common.stored(own.groupBy("leaf").agg(F.sum("docs").alias("held"), F.count(F.lit(1)).alias("rows")), "mixed-nodes")
    own = common.hot_split(own, nodes, ["leaf"], ["held"], own.count())
    words = own.select("leaf", "line", "n", "docs", "held", F.posexplode(F.split("form", " ")).alias("place", "word"))
    words = words.withColumn("slot", F.xxhash64("leaf", "place", "word"))
    seen = words.where(F.col("word") != "<*>").groupBy("slot").agg(F.sum("docs").alias("met"), F.first("held").alias("held"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    constant = common.stored(seen.where((F.col("met") >= needed) & (F.col("met") >= node_share * F.col("held"))).select("slot", "rows", F.lit(True).alias("constant")), "template-constants")
    count = constant.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    known = common.hot_split(words.select("leaf", "line", "place", "word", "slot"), constant, ["slot"], ["constant"], count)
    fixed = F.col("constant").isNotNull()
    part = F.xxhash64("place", F.when(fixed, F.col("word")).otherwise("<*>"))
    whole = known.groupBy("leaf", "line").agg(F.bit_xor(part).alias("parts"), F.sum(F.when(fixed, 1).otherwise(0)).alias("fixed"), F.count(F.lit(1)).alias("n"))
    return whole.where(F.col("fixed") >= constant_share * F.col("n")).select("leaf", "line", F.xxhash64("leaf", "parts").alias("template"))


def dropped_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS, tiny_docs: int = TINY_DOCS, constant_share: float = CONSTANT_SHARE, node_share: float = NODE_SHARE) -> DataFrame:
    """row_key, at: the lines to drop."""
    spark, mark = df.sparkSession, common.mark()
    needed = F.when(F.col("n") >= long_tokens, min_docs).when(F.col("n") >= min_tokens, short_docs).otherwise(tiny_docs)
    with_form = lines_of(df, id_col, text_col, depth)
    lines = common.stored(with_form.drop("form"), "lines")
    ordinary = F.col("n") >= min_tokens
    found = common.stored(templates(lines.where(ordinary), with_form.where(ordinary), needed, constant_share, node_share), "templates")
    total = lines.count()
    # hot lines are listed too where they have no template, so that they leave the shuffled join
    per_line = lines.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("rows")).join(found, ["leaf", "line"], "left").where(F.col("template").isNotNull() | (F.col("rows") >= common.hot_rows(spark, total)))
    per_line = common.stored(per_line, "line-templates")
    named = common.hot_split(lines, per_line, ["leaf", "line"], ["template"], total)
    own = F.when(ordinary & (F.col("fixed") >= constant_share * F.col("n")), F.xxhash64("leaf", "line")).otherwise(F.xxhash64(F.lit("exact"), "exact"))
    named = common.stored(named.withColumn("template", F.coalesce("template", own)).select("doc_id", "row_key", "at", "n", "template"), "named-lines")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    docs = named.groupBy("template", "row_key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    recurring = docs.groupBy("template").agg(first.alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.sum("rows").alias("rows"))
    recurring = recurring.select("template", "rows", F.when(F.col("docs") >= needed, F.col("first.row_key")).alias("keeper"))
    recurring = common.stored(recurring.where(F.col("keeper").isNotNull() | (F.col("rows") >= common.hot_rows(spark, total))), "recurring")
    common.drop_since(spark, mark, named, recurring)
    hit = common.hot_split(named, recurring, ["template"], ["keeper"], total)
    return hit.where("keeper is not null and keeper <> row_key").select("row_key", "at")


def drop_recurring_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """df with recurring lines taken out of its text, and n_lines and n_dropped."""
    key, drop_at, parts = common.private(df, "row_key", "drop_at", "parts")
    drops = dropped_lines(df, id_col=id_col, text_col=text_col, **parameters).groupBy(F.col("row_key").alias(key)).agg(F.collect_set("at").alias(drop_at))
    text = F.col(text_col).cast("string")
    keyed = df.drop("n_lines", "n_dropped").withColumn(key, F.xxhash64(F.col(id_col).cast("long"), text))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop_at))
    left = F.when(F.col(drop_at).isNull(), text).otherwise(F.array_join(F.transform(F.array_sort(kept), lambda i: F.element_at(F.col(parts), i + 1)), "\n"))
    out = keyed.join(drops, key, "left").withColumn(parts, F.split(text, "\n")).withColumn(text_col, left)
    counts = {"n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size(drop_at), F.lit(0)).cast("long")}
    return out.select(*[c for c in df.columns if c not in counts], *[c.alias(n) for n, c in counts.items()])


def op8_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql(table: str = "documents", out: str = "doc_id, text, n_lines, n_dropped") -> str:
    """The same in DuckDB's SQL with the default parameters."""
    blanks = r"[ \t\r\x0b\f]"
    needed = lambda n: f"CASE WHEN {n} >= {LONG_TOKENS} THEN {MIN_DOCS} WHEN {n} >= {MIN_TOKENS} THEN {SHORT_DOCS} ELSE {TINY_DOCS} END"
    return rf"""
WITH base AS (SELECT *, hash(doc_id, text) AS row_key FROM {table}),
raw AS (
  SELECT doc_id, row_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM base WHERE text IS NOT NULL
), tidy AS (
  SELECT doc_id, row_key, line_no, CASE WHEN regexp_matches(line, '[\t\r\x0b\f]|  |^ | $') THEN trim(regexp_replace(line, '{blanks}+', ' ', 'g')) ELSE line END AS line FROM raw
), formed AS (
  SELECT doc_id, row_key, line_no, line, CASE WHEN regexp_matches(line, '[0-9@/]') THEN regexp_replace(line, '[^ ]*[0-9@/][^ ]*', '<*>', 'g') ELSE line END AS form FROM tidy
), lines AS (
  SELECT *, string_split(form, ' ') AS words, len(string_split(form, ' ')) AS n FROM formed WHERE form <> ''
), leafed AS (
  SELECT *, n || ' ' || array_to_string(words[1:{DEPTH}], ' ') AS leaf, n - len(list_filter(words, lambda w: w = '<*>')) AS fixed FROM lines
), mixed AS (
  SELECT leaf FROM leafed WHERE n >= {MIN_TOKENS} GROUP BY leaf HAVING count(DISTINCT form) > 1 AND count(DISTINCT row_key) > 1
), own AS (
  SELECT leaf, form, words, n, count(DISTINCT row_key) AS docs FROM leafed SEMI JOIN mixed USING (leaf) GROUP BY ALL
), nodes AS (SELECT leaf, sum(docs) AS held FROM own GROUP BY leaf
), cells AS (
  SELECT leaf, form, n, docs, held, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM own JOIN nodes USING (leaf)
), constants AS (
  SELECT leaf, place, word FROM cells WHERE word <> '<*>' GROUP BY leaf, place, word
  HAVING sum(docs) >= {needed("max(n)")} AND sum(docs) >= {NODE_SHARE}::DOUBLE * max(held)
), built AS (
  SELECT o.leaf, o.form, string_agg(CASE WHEN c.word IS NULL THEN '<*>' ELSE o.word END, ' ' ORDER BY o.place) AS template,
         count(c.word) AS fixed, count(*) AS n
  FROM cells o LEFT JOIN constants c ON o.leaf = c.leaf AND o.place = c.place AND o.word = c.word GROUP BY o.leaf, o.form
), named AS (
  SELECT l.doc_id, l.row_key, l.line_no, l.n,
         CASE WHEN b.template IS NOT NULL THEN 'template ' || b.template
              WHEN l.n >= {MIN_TOKENS} AND l.fixed >= {CONSTANT_SHARE} * l.n THEN 'line ' || l.form ELSE 'exact ' || l.line END AS template,
         CASE WHEN b.template IS NULL AND (l.n < {MIN_TOKENS} OR l.fixed < {CONSTANT_SHARE} * l.n) THEN '' ELSE l.leaf END AS leaf
  FROM leafed l LEFT JOIN (SELECT * FROM built WHERE fixed >= {CONSTANT_SHARE} * n) b ON l.leaf = b.leaf AND l.form = b.form
), recurring AS (
  SELECT leaf, template, arg_min(row_key, (doc_id IS NULL, coalesce(doc_id, 0))) AS keeper FROM named GROUP BY leaf, template
  HAVING count(DISTINCT row_key) >= {needed("max(n)")}
), drops AS (
  SELECT row_key, line_no FROM named JOIN recurring USING (leaf, template) WHERE row_key <> keeper GROUP BY row_key, line_no
), counted AS (SELECT row_key, count(*) AS n_dropped FROM drops GROUP BY row_key
), left_over AS (
  SELECT r.row_key, string_agg(r.line, chr(10) ORDER BY r.line_no) AS text
  FROM (SELECT DISTINCT row_key, line_no, line FROM raw) r ANTI JOIN drops USING (row_key, line_no) GROUP BY r.row_key
), result AS (
  SELECT b.* EXCLUDE (text), CASE WHEN c.n_dropped IS NULL THEN b.text ELSE coalesce(x.text, '') END AS text,
         coalesce(len(string_split(b.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c.n_dropped, 0)::BIGINT AS n_dropped
  FROM base b LEFT JOIN counted c USING (row_key) LEFT JOIN left_over x USING (row_key)
)
SELECT {out} FROM result
"""


OP8_SQL = sql()
