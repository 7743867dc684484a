"""Labels, concepts and prompts: text cleaning, rules, overrides, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..operators import concepts, dictionary
from ..sources import files, sinks
from ..sources.shared import shared_path
from ..sources.tables import table
from .registry import query, r6

_CLEAN = r"""list_transform({0}, lambda x: trim(regexp_replace(replace(lower(x), '_', ' '), '[^a-z0-9 \-]', '', 'g')))"""
_KEPT = r"""list_filter({0}, lambda x: x <> '' AND len(regexp_extract_all(x, '[^ ]+')) <= 5)"""
_FIRST20 = "list_filter({0}, lambda x, i: list_position({0}, x) = i)[1:20]"


@query(rf"""
WITH a AS (SELECT doc_id, {_KEPT.format(_CLEAN.format("string_split_regex(text, '[.,]')"))} AS l FROM documents)
SELECT doc_id, array_to_string({_FIRST20.format("l")}, '|') AS labels FROM a
""")
def t01_clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", t.clean_labels(F.split("text", "[.,]")).alias("l"))
    return d.select("doc_id", F.array_join("l", "|").alias("labels"))


_PROPS = "SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events"


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.from_json("props", "k bigint")["k"].alias("k"), "value")


@query(f"""
WITH p AS ({_PROPS})
SELECT event_id, CASE WHEN k % 3 = 0 THEN '' ELSE event_type || ' seen' || CASE WHEN k % 5 = 0 THEN '' ELSE '|hay bale' END END AS labels, CASE WHEN k % 3 = 0 OR k % 7 = 0 THEN NULL ELSE round((k % 11) / 10, 6) END AS score FROM p
""")
def t03_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with one JSON object; every third one is broken, every seventh has no number."""
    p = _props(spark, sf_dir)
    k = F.col("k")
    unusual = F.when(k % 5 == 0, F.lit("[]")).otherwise(F.lit('["hay_bale"]'))
    score = F.when(k % 7 == 0, F.lit('"high"')).otherwise((k % 11).cast("string"))
    body = F.concat(F.lit('so {"objects": ["'), F.initcap("event_type"), F.lit('_seen"], "unusual_objects": '), unusual, F.lit(', "anomaly_score": '), score, F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("}")), F.lit(" end"))
    labels, number = t.judge(body)
    return p.select("event_id", F.array_join(labels, "|").alias("labels"), r6(number).alias("score"))


_SETS = "SELECT user_id, k % 9 AS t, list_sort(list_distinct(list(event_type || CASE WHEN value > 100 THEN ' near' ELSE ' far' END))) AS c FROM p GROUP BY user_id, k % 9"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _props(spark, sf_dir)
    c = t.concept(F.col("event_type"), F.when(F.col("value") > 100, "near").otherwise("far"))
    return p.groupBy("user_id", (F.col("k") % 9).alias("t")).agg(F.collect_set(c).alias("c"))


@query(f"WITH p AS ({_PROPS}), s AS ({_SETS}) SELECT user_id, t, array_to_string(list_transform(c, lambda x: 'a ' || x), ', ') AS items FROM s")
def t05_prompt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("user_id", "t", t.described(F.col("c")).alias("items"))


@query(f"WITH p AS ({_PROPS}), s AS ({_SETS}) SELECT user_id AS run, t, array_to_string(c, '|') AS concepts, 'a ' || array_to_string(c, ', a ') AS prompt, CASE WHEN t % 3 = 0 THEN NULL ELSE t / 7 END AS kerb FROM s")
def k6_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of points with their concepts and prompts, written as JSON lines of whole runs and read back; what is no number is null."""
    path = shared_path(spark, "corpus")
    kerb = F.when(F.col("t") % 3 == 0, float("inf")).otherwise(F.col("t") / 7)
    points = _sets(spark, sf_dir).select(F.col("user_id").alias("run"), "t", F.array_sort("c").alias("concepts"), kerb.alias("kerb"))
    sinks.write_corpus(points.withColumn("prompts", F.create_map(F.lit("gt"), t.described(F.col("concepts")))), path)
    read = files.corpus(spark, path, "t bigint, concepts array<string>, kerb double, prompts map<string, string>")
    return read.select("run", "t", F.array_join("concepts", "|").alias("concepts"), F.col("prompts")["gt"].alias("prompt"), "kerb")


_ART = "CASE WHEN x[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' || x ELSE 'a ' || x END"


@query(f"""
WITH p AS ({_PROPS}), s AS ({_SETS}), a AS (SELECT user_id, t, list_transform(c, lambda x: {_ART}) AS c FROM s)
SELECT user_id, t, 'I see ' || CASE WHEN len(c) > 1 THEN array_to_string(c[:-2], ', ') || ' and ' || c[-1] ELSE c[1] END || '.' AS sentence FROM a
""")
def t06_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("user_id", "t", t.sentence(F.array_sort("c")).alias("sentence"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'water' WHEN p_type LIKE 'ECONOMY%' THEN 'an item' ELSE 'a part' END AS form, CASE WHEN lower(p_name) LIKE '%re%' THEN 'red' WHEN lower(p_name) LIKE '%a%' THEN 'other' END AS rule,
    split_part(p_brand, '#', 1) AS head, CASE WHEN p_brand = 'Brand#12' THEN 'exact' WHEN p_brand LIKE 'Brand#1%' THEN 'one' WHEN p_brand LIKE 'Brand#%' THEN 'many' ELSE 'none' END AS mapped, p_type || '_' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS run_name FROM part
""")
def t08_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact names before prefixes before a default; the first rule whose fragment occurs; names by template."""
    p = table(spark, sf_dir, "part")
    form = F.when(F.col("p_size") % 3 == 0, "water").when(F.col("p_type").startswith("ECONOMY"), "item").otherwise("part")
    asked = F.expr("substring(x, 10, 100)")  # what follows "photo of "
    return p.withColumn("x", t.query_text(form, "photo of {}")).select(
        "p_partkey", asked.alias("form"), t.first_fragment(F.col("p_name"), [("re", "red"), ("a", "other")]).alias("rule"), t.before_first(F.col("p_brand"), "#").alias("head"),
        t.by_prefix(F.col("p_brand"), {"Brand#12": "exact"}, {"Brand#1": "one", "Brand#": "many"}, F.lit("none")).alias("mapped"), t.run_name(F.col("p_type"), F.col("p_size")).alias("run_name"),
    )


@query("SELECT c_custkey, CAST(len(s) AS INT) AS n, CAST(list_sum(s) AS BIGINT) AS total FROM (SELECT c_custkey, list_concat(range(c_custkey % 5 + 1, c_custkey % 5 + 1 + c_nationkey % 4 + 1), [c_custkey]) AS s FROM customer)")
def t11_seed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"2-4,17" as the seeds it stands for."""
    c = table(spark, sf_dir, "customer")
    a = F.col("c_custkey") % 5 + 1
    s = t.seeds(F.concat_ws("", a.cast("string"), F.lit("-"), (a + F.col("c_nationkey") % 4).cast("string"), F.lit(","), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", s.alias("s")).select("c_custkey", F.size("s").cast("int").alias("n"), F.aggregate("s", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("total"))


@query("""
WITH b AS (SELECT user_id AS run, event_id AS t, event_id % 6 AS id, event_type AS object, CASE WHEN value > 100 THEN 'near' ELSE 'far' END AS predicate FROM events),
tr AS (SELECT run, id, CASE WHEN id = 1 THEN 'lorry' END AS o, CASE WHEN id = 2 THEN 'beside' END AS p, id = 3 AS d FROM (SELECT DISTINCT run, id FROM b) WHERE run % 2 = 0 AND id BETWEEN 1 AND 3),
fr AS (SELECT run, t, id, 'bus' AS o, NULL AS p, false AS d FROM b WHERE t % 10 = 0),
e AS (SELECT b.run, b.t, coalesce(fr.o, tr.o, object) || ' ' || coalesce(fr.p, tr.p, predicate) AS concept FROM b LEFT JOIN tr ON b.run = tr.run AND b.id = tr.id LEFT JOIN fr ON b.run = fr.run AND b.t = fr.t AND b.id = fr.id WHERE NOT coalesce(fr.d, tr.d, false)),
a AS (SELECT run, t, 'cone ahead' AS concept FROM b WHERE t % 25 = 0)
SELECT run, t, string_agg(concept, '|' ORDER BY concept) AS concepts FROM (SELECT DISTINCT * FROM (SELECT * FROM e UNION ALL SELECT * FROM a)) GROUP BY run, t
""")
def j08_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand corrections: a frame's edit before its track's before what was recorded; dropped instances go, added ones come."""
    e = table(spark, sf_dir, "events")
    b = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("t"), (F.col("event_id") % 6).alias("id"), F.col("event_type").alias("object"), F.when(F.col("value") > 100, "near").otherwise("far").alias("predicate"))
    tracks = b.select("run", "id").distinct().where("run % 2 = 0 and id between 1 and 3").select("run", "id", F.when(F.col("id") == 1, "lorry").alias("object"), F.when(F.col("id") == 2, "beside").alias("predicate"), (F.col("id") == 3).alias("drop"))
    frames = b.where("t % 10 = 0").select("run", "t", "id", F.lit("bus").alias("object"), F.lit(None).cast("string").alias("predicate"), F.lit(False).alias("drop"))
    added = b.where("t % 25 = 0").select("run", "t", F.lit("cone").alias("object"), F.lit("ahead").alias("predicate"))
    return concepts.effective(b, tracks, frames, added).groupBy("run", "t").agg(F.array_join(F.array_sort(F.collect_set("concept")), "|").alias("concepts"))


@query("SELECT conv_id, turn, n_same FROM conversations JOIN (SELECT text, count(*) AS n_same FROM conversations GROUP BY text) USING (text)")
def s11_text_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text once, joined back to all rows that have it."""
    c = table(spark, sf_dir, "conversations").withColumn("key", F.sha2("text", 256))
    words = c.groupBy("key").agg(F.count("*").alias("n_same"))
    return c.select("conv_id", "turn", "key").join(words, "key").select("conv_id", "turn", "n_same")


_LETTER = "len(lower(text)) - len(replace(lower(text), chr(CAST(97 + {0} AS INT)), ''))"


@query(f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS side, list_transform(range(26), lambda i: CAST({_LETTER.format("i")} AS DOUBLE)) AS c FROM conversations WHERE text IS NOT NULL),
n AS (SELECT *, greatest(sqrt(list_dot_product(c, c)), 1e-300) AS norm FROM t)
SELECT conv_id, turn, round(c[1] / norm, 6) AS a, round(c[5] / norm, 6) AS e, round(c[20] / norm, 6) AS t, (SELECT count(DISTINCT text) FROM conversations WHERE turn % 2 = 0) AS first_new,
    (SELECT count(DISTINCT text) FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE turn % 2 = 0 AND text IS NOT NULL)) AS then_new, CAST(0 AS BIGINT) AS last_new FROM n
""")
def s11_encoded_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded once: the even turns', then what all others add, then nothing; each row with its text's vector."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    known = dictionary.TextDictionary(shared_path(spark, "dictionary"), "letters")
    new = [known.update(x, "text") for x in (rows.where("turn % 2 = 0"), rows, rows)]
    found = known.joined(rows.where("text IS NOT NULL"), "text")
    counts = [F.lit(n).cast("bigint").alias(name) for n, name in zip(new, ("first_new", "then_new", "last_new"), strict=True)]
    return found.select("conv_id", "turn", *(r6(F.col("v")[k]).alias(name) for k, name in ((0, "a"), (4, "e"), (19, "t"))), *counts)


@query("SELECT DISTINCT event_type || ' ' || k % 40 AS prompt FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type || ' ' || k % 40 NOT IN (SELECT event_type || ' ' || user_id % 40 FROM events WHERE user_id % 40 < 23)")
def j11_missing_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that the dictionary does not have yet."""
    p = _props(spark, sf_dir)
    known = p.where("user_id % 40 < 23").select(F.concat_ws(" ", "event_type", (F.col("user_id") % 40).cast("string")).alias("prompt")).distinct()
    return p.select(F.concat_ws(" ", "event_type", (F.col("k") % 40).cast("string")).alias("prompt")).distinct().join(known, "prompt", "left_anti")


@query(f"WITH p AS ({_PROPS}), s AS ({_SETS}) SELECT array_to_string(c, ', ') AS prompt, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY c")
def g28_prompt_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sets(spark, sf_dir).select(F.array_join(F.array_sort("c"), ", ").alias("prompt"))
    total = s.agg(F.count("*").alias("total"))
    return s.groupBy("prompt").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("prompt", "n", r6(F.col("n") / F.col("total")).alias("share"))  # one row


@query(f"""
WITH p AS ({_PROPS}), s AS ({_SETS}), l AS (SELECT user_id, t, unnest(c) AS c FROM s), f AS (SELECT c, min(user_id * 10 + t) AS first FROM l GROUP BY c)
SELECT s.user_id, s.t, CAST(len(s.c) AS INT) AS n_concepts, (SELECT count(*) FROM f WHERE first <= s.user_id * 10 + s.t) AS seen FROM s
""")
def g25_distinct_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of a frame and how many distinct ones there were up to it."""
    s = _sets(spark, sf_dir).withColumn("place", F.col("user_id") * 10 + F.col("t"))
    return concepts.distinct_so_far(s, "place", "c").select("user_id", "t", F.size("c").cast("int").alias("n_concepts"), "seen")


@query("""
WITH d AS (SELECT l_orderkey AS frame, l_linenumber AS box, l_suppkey % 7 AS label, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 7 ORDER BY l_extendedprice DESC, l_linenumber) AS i FROM lineitem WHERE l_extendedprice >= 20000),
o AS (SELECT frame, label, score, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box) AS n FROM d WHERE i = 1)
SELECT frame, label, CAST(n AS INT) AS n, round(score, 6) AS score FROM o WHERE n <= 3
""")
def f07_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame the best box of each label above a threshold, and of those the best three."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("box"), (F.col("l_suppkey") % 7).alias("label"), F.col("l_extendedprice").alias("score"))
    return concepts.top_labels(d, 20000.0, 3).select("frame", "label", "n", r6("score").alias("score"))


@query("""
WITH RECURSIVE b AS (SELECT l_orderkey AS frame, CAST(l_linenumber % 2 AS VARCHAR) AS concept, l_extendedprice AS score, l_partkey % 50 * 1.0::DOUBLE AS x0, l_suppkey % 20 * 1.0::DOUBLE AS y0, l_partkey % 50 + l_quantity AS x1, l_suppkey % 20 + 15.0::DOUBLE AS y1 FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, x0, y0, concept, x1, y1) AS i FROM b),
r AS (SELECT frame, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(concept VARCHAR, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept, false AS took FROM (SELECT DISTINCT frame FROM b)
    UNION ALL
    SELECT frame, i, CASE WHEN clear THEN list_append(kept, {'concept': concept, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) ELSE kept END, clear
    FROM (SELECT *, len(kept) < 15 AND len(list_filter(kept, lambda k: k.concept = concept OR greatest(least(k.x1, x1) - greatest(k.x0, x0), 0) * greatest(least(k.y1, y1) - greatest(k.y0, y0), 0)
            > 0.5::DOUBLE * ((k.x1 - k.x0) * (k.y1 - k.y0) + (x1 - x0) * (y1 - y0) - greatest(least(k.x1, x1) - greatest(k.x0, x0), 0) * greatest(least(k.y1, y1) - greatest(k.y0, y0), 0)))) = 0 AS clear
        FROM (SELECT r.frame, o.i, r.kept, o.concept, o.x0, o.y0, o.x1, o.y1 FROM r JOIN o ON o.frame = r.frame AND o.i = r.i + 1)))
SELECT o.frame, concept, score, x0, y0, x1, y1 FROM r JOIN o ON o.frame = r.frame AND o.i = r.i WHERE took
""")
def f14_greedy_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by falling score, each kept unless it overlaps a kept one of its frame."""
    i = table(spark, sf_dir, "lineitem")
    boxes = i.select(F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") % 2).cast("string").alias("concept"), F.col("l_extendedprice").alias("score"), (F.col("l_partkey") % 50 * 1.0).alias("x0"), (F.col("l_suppkey") % 20 * 1.0).alias("y0"), (F.col("l_partkey") % 50 + F.col("l_quantity")).alias("x1"), (F.col("l_suppkey") % 20 + 15.0).alias("y1"))
    return concepts.greedy_boxes(boxes, 0.5, 15)


@query("""
WITH p AS (SELECT l_suppkey AS key, l_partkey % 640 AS u, CAST(l_quantity AS INT) AS v, l_orderkey AS o, l_linenumber AS n FROM lineitem),
g AS (SELECT key, count(*) AS px, min(u) AS x0, min(v) AS y0, max(u) + 1 AS x1, max(v) + 1 AS y1, quantile_cont(v, 0.95) AS low FROM p GROUP BY key HAVING count(*) >= 30),
b AS (SELECT key, u, v, o, n, row_number() OVER (PARTITION BY key ORDER BY u, o, n) AS i, count(*) OVER (PARTITION BY key) AS c FROM p JOIN g USING (key) WHERE v >= low)
SELECT g.key, px, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS INT) AS y1, CAST(u AS BIGINT) AS foot_u, CAST(v AS INT) AS foot_v FROM g JOIN b ON g.key = b.key WHERE i = c // 2 + 1
""")
def g21_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to instances: count, box, and the middle one of the lowest five per cent of pixels."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_partkey") % 640).alias("u"), F.col("l_quantity").cast("int").alias("v"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    return concepts.instances(p, least=30)


@query("""
WITH s AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS tick, o_totalprice AS px FROM orders)
SELECT run, CAST(min(tick) AS INT) AS onset, CAST(max(tick) + 1 AS INT) AS until FROM s WHERE px >= 100000 GROUP BY run HAVING count(*) >= 5
""")
def g23_visibility_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(w).alias("tick"), F.col("o_totalprice").alias("px"))
    return s.where("px >= 100000").groupBy("run").agg(F.count("*").alias("n"), F.min("tick").alias("onset"), (F.max("tick") + 1).alias("until")).where("n >= 5").drop("n")


@query("""
WITH a AS (SELECT l_suppkey AS id, l_orderkey AS t FROM lineitem WHERE l_linenumber = 1), b AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT t, a.id, coalesce(name, 'other ' || a.id % 5) AS object, CASE WHEN name IS NULL THEN 'place' ELSE 'actor' END AS src FROM a LEFT JOIN b ON a.id = b.id
""")
def j10_instance_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance is the actor of its number, else what stands at its place."""
    a = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("t"))
    b = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.join(b, "id", "left").select("t", "id", F.coalesce("name", F.concat(F.lit("other "), (F.col("id") % 5).cast("string"))).alias("object"), F.when(F.col("name").isNull(), "place").otherwise("actor").alias("src"))
