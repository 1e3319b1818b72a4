"""Rule reports as XML and text, graph files, lists, and label look-ups in HTML reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checkloom.functions.text import signature_parts
from checkloom.operators.graph import union_all

RULE_SCHEMA = "ep string, rule_id string, antecedent struct<item:array<string>>, consequent struct<item:array<string>>, alternative struct<item:array<string>>, missing struct<item:array<string>>, entrypoints struct<item:array<string>>, support long, confidence double, jaccard double, lift double, conviction double"


def write_rules_xml(rules: DataFrame, path: str) -> None:
    """One <rule> element for each row; alternatives have an element of their own."""
    as_items = lambda c: F.struct(F.col(c).alias("item")).alias(c)
    out = rules.select(*[as_items(c) if t.startswith("array") else F.col(c) for c, t in rules.dtypes])
    out.write.format("xml").option("rootTag", "rules").option("rowTag", "rule").save(path)


def read_rules_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rules with arrays, from all files under `path`."""
    x = spark.read.format("xml").schema(RULE_SCHEMA).option("rowTag", "rule").option("recursiveFileLookup", "true").load(path)
    return x.select(*[F.coalesce(F.col(f"{c}.item"), F.array().cast("array<string>")).alias(c) if t.startswith("struct") else F.col(c) for c, t in x.dtypes])


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """A database file's rows of element `row`: device data, marks, graphs."""
    return spark.read.format("xml").schema(schema).option("rowTag", row).option("recursiveFileLookup", "true").load(path)


def write_xml(df: DataFrame, path: str, row: str, root: str = "database") -> None:
    df.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def rule_text(confidence: Column, lhs: Column, rhs: Column) -> Column:
    """Confidence, the antecedent's lines, and the consequent's lines marked +++."""
    lines = lambda x, p: F.array_join(F.transform(x, lambda i: F.concat(F.lit(p), i)), "\n")
    return F.concat(F.format_string("Confidence: %.4f\n", confidence), lines(lhs, "\t"), F.lit("\n"), lines(rhs, "\t+++ "))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the lines of a GraphML document in the order of part. nodes: id, label, color; edges: src, tgt, weight."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, '<graphml><key id="l" for="node" attr.name="label"/><key id="c" for="node" attr.name="color"/><key id="w" for="edge" attr.name="weight"/><graph edgedefault="directed">')], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), esc("id"), F.lit('"><data key="l">'), esc("label"), F.lit('</data><data key="c">'), F.coalesce(esc("color"), F.lit("")), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("tgt"), F.lit('"><data key="w">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    return union_all([head, n, e, spark.createDataFrame([(3, "</graph></graphml>")], "part int, value string")])


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, lines: int = 1_000_000) -> None:
    """A graph as GraphML files under `path`, each a document of its own of about so many lines, so that no task writes or reads
    a whole large graph. One file for a small one. Nodes and edges are dealt over the files by their text."""
    every = graphml(nodes, edges)
    n = max(1, -(-every.count() // lines))
    frame = every.where("part in (0, 3)").crossJoin(every.sparkSession.range(n).withColumnRenamed("id", "file"))
    inside = every.where("part in (1, 2)").withColumn("file", F.pmod(F.xxhash64("value"), F.lit(n)))
    frame.unionByName(inside).repartition(n, "file").sortWithinPartitions("file", "part").select("file", "value").write.partitionBy("file").text(path)


def parse_graphml(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, label, color) and (src, tgt, weight) of GraphML lines with one element each (value)."""
    get = lambda p: F.regexp_extract("value", p, 1)
    un = lambda c: F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    n = lines.where(F.startswith("value", F.lit("<node"))).select(un(get('<node id="([^"]*)"')).alias("id"), un(get('<data key="l">([^<]*)')).alias("label"), un(get('<data key="c">([^<]*)')).alias("color"))
    e = lines.where(F.startswith("value", F.lit("<edge"))).select(un(get('source="([^"]*)"')).alias("src"), un(get('target="([^"]*)"')).alias("tgt"), get('<data key="w">([^<]*)').cast("int").alias("weight"))
    return n, e


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, data) and (src, tgt, data) of any GraphML files under `path`; data maps the names of the file's own keys to
    values, so no fixed key is needed."""
    data = "data array<struct<_key:string, _VALUE:string>>"
    keys = read_xml(spark, path, "key", "_id string, `_attr.name` string").select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("name")).distinct()
    named = F.broadcast(keys.agg(F.map_from_entries(F.collect_list(F.struct("key", "name"))).alias("names")))
    pairs = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string, _VALUE:string>>")), lambda x: F.struct(F.coalesce(F.try_element_at("names", x["_key"]), x["_key"]).alias("k"), x["_VALUE"].alias("v"))))
    n = read_xml(spark, path, "node", f"_id string, {data}").crossJoin(named).select(F.col("_id").alias("id"), pairs.alias("data"))
    e = read_xml(spark, path, "edge", f"_source string, _target string, {data}").crossJoin(named).select(F.col("_source").alias("src"), F.col("_target").alias("tgt"), pairs.alias("data"))
    return n, e


def tgf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): trivial graph format: nodes, #, edges."""
    mark = nodes.sparkSession.createDataFrame([(1, "#")], "part int, value string")
    n = nodes.select(F.lit(0).alias("part"), F.concat_ws(" ", F.col("id").cast("string"), F.col("label")).alias("value"))
    return union_all([n, mark, edges.select(F.lit(2).alias("part"), F.concat_ws(" ", F.col("src").cast("string"), F.col("tgt").cast("string"), F.col("weight").cast("string")).alias("value"))])


def name_list(lines: DataFrame) -> DataFrame:
    """Distinct names of a list file (value): comments after `//` and blank lines are dropped."""
    return lines.select(F.trim(F.regexp_replace("value", "//.*$", "")).alias("name")).where("name <> ''").distinct()


def group_list(lines: DataFrame) -> DataFrame:
    """(group, name): a line `group` begins the next group. lines: file, idx, value; a file is small and read in order."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    is_group = F.lower(F.trim("value")).rlike(r"^group\b")
    x = lines.select("file", "idx", F.trim("value").alias("name"), is_group.alias("g")).withColumn("group", F.sum(F.col("g").cast("int")).over(w))
    return x.where("not g and name <> '' and not startswith(name, '//')").select("file", "group", "name")


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, href): targets of the links of a page, with repeats."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*?href="([^"]*)"'), F.lit(1))).alias("href"))


def labelled_texts(pages: DataFrame, prefix: str) -> DataFrame:
    """(page_id, value): element texts that begin with a prefix, without it, as report labels do."""
    t = F.explode(F.regexp_extract_all("html", F.lit(r">\s*([^<]+?)\s*<"), F.lit(1))).alias("t")
    return pages.select("page_id", t).where(F.startswith("t", F.lit(prefix))).select("page_id", F.trim(F.substring("t", F.lit(len(prefix) + 1), F.length("t"))).alias("value"))


def keyed(frames: dict[str, DataFrame]) -> DataFrame:
    """Several databases as one table with a key column."""
    return union_all([df.withColumn("key", F.lit(k)) for k, df in frames.items()])


def filter_facts(lines: DataFrame) -> DataFrame:
    """(form, sig, class, type, name, args, value) of fact lines (value): `+ MethodSignature <..>` (query), `Method: <..>`
    (tested), `Field: <..>` (tested_field), `StringConst: "..."` (string, whose text is the value), `<..>` (method or field, by its
    parentheses); other lines are skipped, a wanted line without a signature or a quoted text is an error."""
    line = F.trim("value")
    begins = lambda x: F.startswith(line, F.lit(x))
    form = F.when(begins("+"), "query").when(begins("Method: <"), "tested").when(begins("Field: <"), "tested_field").when(begins("StringConst:"), "string").when(begins("<"), "fact")
    sig = F.regexp_replace(F.regexp_replace(line, r"^\+\s+MethodSignature\s+", ""), r"^(Method|Field|StringConst):\s+", "")
    x = lines.select(form.alias("form"), sig.alias("sig")).where("form is not null")
    p, text, is_text = signature_parts(F.col("sig")), F.regexp_extract("sig", r'^"([\s\S]*)"$', 1), F.col("form") == "string"
    good = F.when(is_text, F.col("sig").rlike(r'^"[\s\S]*"$')).otherwise(p.isNotNull())
    ok = F.when(good, F.when(~is_text, F.col("sig"))).otherwise(F.raise_error(F.concat(F.lit("malformed fact: "), F.col("sig"))))
    kind = F.when(F.col("form") != "fact", F.col("form")).when(F.contains("sig", F.lit("(")), "method").otherwise("field")
    return x.select(kind.alias("form"), ok.alias("sig"), p["full_class"].alias("class"), p["type"].alias("type"), p["name"].alias("name"), p["args"].alias("args"), F.when(is_text, text).alias("value"))
