"""Queries of selections, roll-ups and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.functions import tags as T
from stratafold.operators import selecting, tables
from stratafold.operators.ranking import ranked
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views

BUDGET = 20000.0


def o01_recent(s: SparkSession, d: str) -> DataFrame:
    return fx.job_rows(s, d).orderBy(F.col("created_at").desc(), F.col("id")).limit(20)


def a14_timing_rollup(s: SparkSession, d: str) -> DataFrame:
    return fx.timings(s, d).groupBy("phase").agg(F.sum("us").alias("total"), F.min("us").alias("least"), F.max("us").alias("most"), F.count(F.lit(1)).alias("n"))


def o02_slowest8(s: SparkSession, d: str) -> DataFrame:
    return fx.timings(s, d).groupBy("piece").agg(F.sum("us").alias("us")).orderBy(F.col("us").desc(), "piece").limit(8)


def o03_keep5(s: SparkSession, d: str) -> DataFrame:
    return selecting.newest(fx.job_rows(s, d), ["key"], [F.col("created_at").desc(), F.col("id").desc()], 5).select("key", "id")


def o04_greedy_budget(s: SparkSession, d: str) -> DataFrame:
    return selecting.greedy_budget(fx.features(s, d), "id", "area", "major", BUDGET).select("id", "area", "major")


def o06_largest(s: SparkSession, d: str) -> DataFrame:
    """The largest feature of each size class; ties to the lower id."""
    return fx.features(s, d).groupBy((F.col("id") % 10).alias("grp")).agg(F.max(F.struct("area", (-F.col("id")).alias("order"))).alias("m")).select("grp", "m.area", (-F.col("m.order")).alias("id"))


def o07_stride(s: SparkSession, d: str) -> DataFrame:
    return selecting.stride(fx.job_events(s, d).select("key", "event_id"), ["key"], [F.col("event_id")], 7)


def o08_fit_sample(s: SparkSession, d: str) -> DataFrame:
    """Every n-th pixel of each group in id order, so that at most 40 remain (a sampling operator)."""
    placed = ranked(fx.pixels(s, d).select("grp", "id"), ["grp"], ["id"])
    return placed.where("__k % ceil(__n / 40D) = 0").select("grp", "id")


def o09_quantile_seed(s: SparkSession, d: str) -> DataFrame:
    """Four seeds spread over each group's distinct sorted values."""
    placed = ranked(fx.pixels(s, d).select("grp", "red").distinct(), ["grp"], ["red"])
    seeds = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).where("__k = i * (__n - 1) DIV 3")
    return seeds.select("grp", "i", "red")


def o10_slots(s: SparkSession, d: str) -> DataFrame:
    """Slots by first use of each colour, letter case aside."""
    named = fx.pixels(s, d).select("id", F.format_string("#%02x%02X%02x", F.col("red") % 4 * 60, F.col("green") % 3 * 80, F.col("blue") % 2 * 200).alias("colour"))
    first = named.groupBy(F.upper("colour").alias("colour")).agg(F.min("id").alias("first"))
    return first.select("colour", (F.row_number().over(Window.orderBy("first")) - 1).alias("slot"))


def o11_order_override(s: SparkSession, d: str) -> DataFrame:
    """An asked order of nations first, then the rest in their own order, each once."""
    asked = s.createDataFrame([(i, n) for i, n in enumerate(["JAPAN", "BRAZIL", "JAPAN", "CANADA"])], "ord int, name string")
    rest = fx.read(s, d, "nation").select((F.col("n_nationkey") + 1000).cast("int").alias("ord"), F.col("n_name").alias("name"))
    known = asked.join(rest.select("name"), "name", "left_semi").select("ord", "name")
    first = known.unionByName(rest).groupBy("name").agg(F.min("ord").alias("ord"))
    return first.select("name", F.row_number().over(Window.orderBy("ord")).alias("place"))


def u01_union_dedup(s: SparkSession, d: str) -> DataFrame:
    """Two overlapping responses, which hold all elements between them, as one set."""
    a, b = fx.grown(s, d).where("id % 3 <> 0"), fx.grown(s, d).where("id % 3 <> 1")
    return a.unionByName(b).groupBy("type", "id").agg(F.max("richness").alias("richness"))


def u04_source_set(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "overpass_ways").groupBy("layer").agg(F.array_join(F.sort_array(F.collect_set(T.tag(F.col("tags"), "source"))), "|").alias("sources"))


def a19_richest(s: SparkSession, d: str) -> DataFrame:
    """The richest copy of each element, the first on a tie; copies without an id are all kept."""
    order = [F.col("richness").desc(), *(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"))]
    return selecting.richest(fx.grown(s, d), ["type", "id"], order, F.col("id") == 0).select("type", "id", "richness", "l_orderkey", "l_linenumber")


def a19_ways(s: SparkSession, d: str) -> DataFrame:
    """The delivered map elements with most tags and points, by id and normal type."""
    kind = F.lower(F.trim("element_type"))
    rows = fx.read(s, d, "overpass_ways").select("delivery_id", F.coalesce(F.col("id"), F.lit(0)).alias("id"), F.when(kind.isNull() | (kind == ""), "way").otherwise(kind).alias("kind"), (F.coalesce(F.size("tags"), F.lit(0)) + F.coalesce(F.size("geometry"), F.lit(0)) + F.coalesce(F.size("members"), F.lit(0))).alias("richness"))
    rows = rows.withColumn("richness", F.greatest("richness", F.lit(0)))
    return selecting.richest(rows, ["kind", "id"], [F.col("richness").desc(), F.col("delivery_id")], F.col("id") == 0)


def a20_cache_totals(s: SparkSession, d: str) -> DataFrame:
    rows = fx.read(s, d, "overpass_responses")
    return rows.groupBy("layer").agg(F.coalesce(F.sum(F.length("body_json")), F.lit(0)).alias("chars"), F.count(F.lit(1)).alias("n"))


def a24_upper_median(s: SparkSession, d: str) -> DataFrame:
    """Per piece the upper median of its timings."""
    w = Window.partitionBy("piece")
    placed = fx.timings(s, d).select("piece", "us", (F.row_number().over(w.orderBy("us")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return placed.where("k = n DIV 2").select("piece", "us")


def s10_covering(s: SparkSession, d: str) -> DataFrame:
    """For each point the smallest station box that covers it, by bucketed boxes."""
    boxes = fx.stations(s, d).selectExpr("id AS box", "lon - (id % 9 + 1) * 5D AS w", "lon + (id % 9 + 1) * 5D AS e", "lat - (id % 7 + 1) * 4D AS so", "lat + (id % 7 + 1) * 4D AS n")
    spread = boxes.withColumn("bx", F.explode(F.sequence(F.floor(F.col("w") / 15), F.floor(F.col("e") / 15)))).withColumn("by", F.explode(F.sequence(F.floor(F.col("so") / 15), F.floor(F.col("n") / 15))))
    points = fx.points(s, d).select("id", "lon", "lat", F.floor(F.col("lon") / 15).alias("bx"), F.floor(F.col("lat") / 15).alias("by"))
    hits = points.join(spread, ["bx", "by"]).where("lon >= w AND lon <= e AND lat >= so AND lat <= n")
    return hits.groupBy("id").agg(F.min(F.struct(F.round((F.col("e") - F.col("w")) * (F.col("n") - F.col("so")), 6).alias("area"), "box")).alias("b")).select("id", "b.box")


def s13_geocoder_cache(s: SparkSession, d: str) -> DataFrame:
    """Searches by lower-case text: how many, how many answered, and the newest answer's id."""
    rows = fx.read(s, d, "place_search_cache").select(F.lower("query").alias("q"), "cache_id", "response_json").where(F.length("q").between(2, 120))
    return rows.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count("response_json").alias("answered"), F.max(F.when(F.col("response_json").isNotNull(), F.col("cache_id"))).alias("newest"))


def s17_recent_jobs(s: SparkSession, d: str) -> DataFrame:
    rows = fx.read(s, d, "jobs").select("id", "status", "created_at").distinct()
    return rows.orderBy(F.col("created_at").desc(), "id", "status").limit(25).select("id", "status")


def k08_conditional_update(s: SparkSession, d: str) -> DataFrame:
    """Progress is written to jobs but for canceled ones."""
    rows = fx.read(s, d, "jobs").select("id", "status", "progress").distinct()
    changed = F.col("status") != "canceled"
    return rows.select("id", F.when(changed, "running").otherwise(F.col("status")).alias("status"), F.when(changed, F.greatest("progress", F.lit(50))).otherwise(F.col("progress")).alias("progress"))


def k09_upsert(s: SparkSession, d: str) -> DataFrame:
    """Setups upserted by name export after export: all before the last as the table, the last as what comes in.

    Of the upserts before the last remain the first id and creation time of a name and its last update, so one grouping by
    name stands for them all.
    """
    rows = fx.read(s, d, "saved_setups").select("id", "name", F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"), "export_no")
    each = rows.groupBy("name", "export_no").agg(F.min("id").alias("id"), F.min("created").alias("created"), F.max("updated").alias("updated"))
    last = rows.agg(F.max("export_no")).first()[0] or 0
    first = F.min_by(F.struct("id", "created"), "export_no").alias("first")
    table = each.where(F.col("export_no") < last).groupBy("name").agg(first, F.max_by("updated", "export_no").alias("updated")).select("first.id", "name", "first.created", "updated")
    return tables.upsert(table, each.where(F.col("export_no") == last).select("id", "name", "created", "updated"), "name", ("id", "created"))


def k10_rename(s: SparkSession, d: str) -> DataFrame:
    """Renaming entries, some to a name that is taken: done, or refused."""
    rows = fx.read(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    asked = rows.select("id", F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(" 2"))).otherwise(F.lit("PERU")).alias("wanted"))
    taken = asked.join(rows.select(F.col("name").alias("wanted"), F.col("id").alias("holder")), "wanted", "left")
    return taken.select("id", "wanted", (F.col("holder").isNotNull() & (F.col("holder") != F.col("id"))).alias("refused"))


def k11_archive(s: SparkSession, d: str) -> DataFrame:
    rows = fx.read(s, d, "saved_setup_versions").select("id", "setup_id", F.unix_micros("saved_at").alias("saved"), "export_no").distinct()
    old, new = rows.where("export_no <= 6"), rows.where("export_no > 6")
    return tables.archive(old, new, "setup_id", [F.col("saved").desc(), F.col("export_no").desc(), F.col("id")], 5)


def k12_restore(s: SparkSession, d: str) -> DataFrame:
    """The first version of each setup swapped with its current text; the resulting current texts' lengths."""
    versions = fx.job_rows(s, d).select("key", F.row_number().over(Window.partitionBy("key").orderBy("id")).alias("version"), F.col("id").cast("string").alias("spec"))
    current = fx.read(s, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("now").alias("spec"))
    asked = versions.where("version = 2").select("key", "version")
    now, back = tables.restore(current, versions, asked, "key", "spec")
    return now.select("key", F.lit(0).alias("version"), "spec").unionByName(back.select("key", "version", "spec"))


def k13_cascade(s: SparkSession, d: str) -> DataFrame:
    parents, children = fx.read(s, d, "customer").select("c_custkey"), fx.read(s, d, "orders").select("o_orderkey", "o_custkey")
    _, left = tables.cascade_delete(parents, children, parents.where("c_custkey % 10 < 4"), "c_custkey", "o_custkey")
    return left


def k14_age_delete(s: SparkSession, d: str) -> DataFrame:
    """What deleting searches fetched before a cutoff frees."""
    rows = fx.read(s, d, "place_search_cache").where(F.col("fetched_at") < F.lit("2024-06-01").cast("timestamp"))
    return rows.agg(F.coalesce(F.sum(F.length("response_json")), F.lit(0)).alias("freed"), F.count(F.lit(1)).alias("n"))


def k15_recover(s: SparkSession, d: str) -> DataFrame:
    return tables.recover(fx.read(s, d, "jobs"), "status").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("progress").alias("progress"))


def t02_monotonic(s: SparkSession, d: str) -> DataFrame:
    return tables.running_max(fx.job_events(s, d), "key", ["ts", "event_id"], "progress").select("event_id", "shown")


def t03_latest(s: SparkSession, d: str) -> DataFrame:
    return fx.job_events(s, d).groupBy("key").agg(F.max(F.struct("ts", "event_id", "kind")).alias("m")).select("key", "m.event_id", "m.kind")


def t05_state_fold(s: SparkSession, d: str) -> DataFrame:
    return tables.final_state(fx.job_events(s, d).withColumn("kind", F.when(F.col("event_id") % 97 == 0, "canceled").otherwise(F.col("kind"))), "key", ["ts", "event_id"], "kind", "canceled")


def t09_files_read(s: SparkSession, d: str) -> DataFrame:
    """Rows by file read."""
    rows = fx.read(s, d, "orders").select(F.regexp_extract("_metadata.file_path", r"([a-z]+)\.parquet", 1).alias("source"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_KIND = "CASE WHEN trim(element_type) IS NULL OR trim(element_type) = '' THEN 'way' ELSE lower(trim(element_type)) END"
QUERIES = {f.__name__: f for f in (o01_recent, a14_timing_rollup, o02_slowest8, o03_keep5, o04_greedy_budget, o06_largest, o07_stride, o08_fit_sample, o09_quantile_seed, o10_slots, o11_order_override, u01_union_dedup, u04_source_set, a19_richest, a19_ways, a20_cache_totals, a24_upper_median, s10_covering, s13_geocoder_cache, s17_recent_jobs, k08_conditional_update, k09_upsert, k10_rename, k11_archive, k12_restore, k13_cascade, k14_age_delete, k15_recover, t02_monotonic, t03_latest, t05_state_fold, t09_files_read)}
ORACLES = {
    "o01_recent": with_views("SELECT * FROM job_rows ORDER BY created_at DESC, id LIMIT 20", "job_rows"),
    "a14_timing_rollup": with_views("SELECT phase, sum(us)::BIGINT AS total, min(us) AS least, max(us) AS most, count(*) AS n FROM timings GROUP BY phase", "timings"),
    "o02_slowest8": with_views("SELECT piece, sum(us)::BIGINT AS us FROM timings GROUP BY piece ORDER BY us DESC, piece LIMIT 8", "timings"),
    "o03_keep5": with_views("SELECT key, id FROM job_rows QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, id DESC) <= 5", "job_rows"),
    "o04_greedy_budget": with_views(f"""WITH RECURSIVE m AS (SELECT id, area, row_number() OVER (ORDER BY area DESC, id) AS k FROM features WHERE NOT major),
        f(k, left_, id, area, taken) AS (SELECT 0::BIGINT, {BUDGET}::DOUBLE - (SELECT sum(area) FROM features WHERE major), NULL::BIGINT, NULL::BIGINT, false UNION ALL SELECT m.k, CASE WHEN m.area <= f.left_ THEN f.left_ - m.area ELSE f.left_ END, m.id, m.area, m.area <= f.left_ FROM f JOIN m ON m.k = f.k + 1)
        SELECT id, area, false AS major FROM f WHERE taken UNION ALL SELECT id, area, major FROM features WHERE major""", "features").replace("WITH features", "WITH RECURSIVE features", 1).replace(", RECURSIVE m AS", ", m AS"),
    "o06_largest": with_views("SELECT id % 10 AS grp, area, id FROM features QUALIFY row_number() OVER (PARTITION BY id % 10 ORDER BY area DESC, id) = 1", "features"),
    "o07_stride": with_views("WITH n AS (SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY key) AS n FROM job_events) SELECT DISTINCT key, event_id FROM n, range(7) t(i) WHERE n <= 7 OR k = CAST(floor(i * (n - 1) / 6 + 0.5) AS BIGINT)", "job_events"),
    "o08_fit_sample": with_views("SELECT grp, id FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM pixels) WHERE k % CAST(ceil(n / 40) AS BIGINT) = 0", "pixels"),
    "o09_quantile_seed": with_views("WITH n AS (SELECT grp, red, row_number() OVER (PARTITION BY grp ORDER BY red) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT DISTINCT grp, red FROM pixels)) SELECT grp, i::INT AS i, red FROM n, range(4) t(i) WHERE k = i * (n - 1) // 3", "pixels"),
    "o10_slots": with_views("WITH c AS (SELECT id, upper('#' || lpad(to_hex(red % 4 * 60), 2, '0') || lpad(to_hex(green % 3 * 80), 2, '0') || lpad(to_hex(blue % 2 * 200), 2, '0')) AS colour FROM pixels) SELECT colour, (row_number() OVER (ORDER BY min(id)) - 1)::INT AS slot FROM c GROUP BY colour", "pixels"),
    "o11_order_override": "WITH a AS (SELECT * FROM (VALUES (0, 'JAPAN'), (1, 'BRAZIL'), (2, 'JAPAN'), (3, 'CANADA')) v(ord, name) WHERE name IN (SELECT n_name FROM nation) UNION ALL SELECT n_nationkey + 1000, n_name FROM nation) SELECT name, row_number() OVER (ORDER BY min(ord))::INT AS place FROM a GROUP BY name",
    "u01_union_dedup": with_views("SELECT type, id, max(richness) AS richness FROM grown GROUP BY type, id", "grown"),
    "u04_source_set": "SELECT layer, coalesce(string_agg(DISTINCT tags['source'], '|' ORDER BY tags['source']), '') AS sources FROM overpass_ways GROUP BY layer",
    "a19_richest": with_views("SELECT type, id, richness, l_orderkey, l_linenumber FROM grown WHERE id <> 0 QUALIFY row_number() OVER (PARTITION BY type, id ORDER BY richness DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax) = 1 UNION ALL SELECT type, id, richness, l_orderkey, l_linenumber FROM grown WHERE id = 0", "grown"),
    "a19_ways": f"WITH r AS (SELECT delivery_id, coalesce(id, 0) AS id, {_KIND} AS kind, (coalesce(cardinality(tags), 0) + coalesce(len(geometry), 0) + coalesce(len(members), 0))::INT AS richness FROM overpass_ways) SELECT * FROM r WHERE id <> 0 QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY richness DESC, delivery_id) = 1 UNION ALL SELECT * FROM r WHERE id = 0",
    "a20_cache_totals": "SELECT layer, coalesce(sum(length(body_json)), 0)::BIGINT AS chars, count(*) AS n FROM overpass_responses GROUP BY layer",
    "a24_upper_median": with_views("SELECT piece, us FROM (SELECT piece, us, row_number() OVER (PARTITION BY piece ORDER BY us) - 1 AS k, count(*) OVER (PARTITION BY piece) AS n FROM timings) WHERE k = n // 2", "timings"),
    "s10_covering": with_views("SELECT p.id, b.id AS box FROM points p JOIN stations b ON abs(p.lon - b.lon) <= (b.id % 9 + 1) * 5 + 0 AND p.lon >= b.lon - (b.id % 9 + 1) * 5 AND p.lon <= b.lon + (b.id % 9 + 1) * 5 AND p.lat >= b.lat - (b.id % 7 + 1) * 4 AND p.lat <= b.lat + (b.id % 7 + 1) * 4 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (b.id % 9 + 1) * (b.id % 7 + 1), b.id) = 1", "points", "stations").replace("abs(p.lon - b.lon) <= (b.id % 9 + 1) * 5 + 0 AND ", ""),
    "s13_geocoder_cache": "SELECT lower(query) AS q, count(*) AS n, count(response_json) AS answered, max(cache_id) FILTER (response_json IS NOT NULL) AS newest FROM place_search_cache WHERE length(lower(query)) BETWEEN 2 AND 120 GROUP BY 1",
    "s17_recent_jobs": "SELECT id, status FROM (SELECT DISTINCT id, status, created_at FROM jobs) ORDER BY created_at DESC NULLS LAST, id, status LIMIT 25",
    "k08_conditional_update": "SELECT id, CASE WHEN status <> 'canceled' THEN 'running' ELSE status END AS status, CASE WHEN status <> 'canceled' THEN greatest(progress, 50) ELSE progress END AS progress FROM (SELECT DISTINCT id, status, progress FROM jobs)",
    "k09_upsert": """WITH r AS (SELECT export_no, name, min(id) AS id, min(epoch_us(created_at)) AS created, max(epoch_us(updated_at)) AS updated FROM saved_setups GROUP BY 1, 2), m AS (SELECT max(export_no) AS last_no FROM saved_setups)
        SELECT first(id ORDER BY export_no) AS id, name, first(created ORDER BY export_no) AS created, last(updated ORDER BY export_no) AS updated, CASE WHEN max(export_no) = any_value(last_no) THEN count(*) = 1 END AS is_new FROM r, m GROUP BY name""",
    "k10_rename": "WITH a AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' 2' ELSE 'PERU' END AS wanted FROM nation) SELECT id, wanted, EXISTS (SELECT 1 FROM nation WHERE n_name = wanted AND n_nationkey <> id) AS refused FROM a",
    "k11_archive": "SELECT id, setup_id, saved, export_no FROM (SELECT DISTINCT id, setup_id, epoch_us(saved_at) AS saved, export_no FROM saved_setup_versions) QUALIFY row_number() OVER (PARTITION BY setup_id ORDER BY saved DESC NULLS LAST, export_no DESC, id) <= 5",
    "k12_restore": with_views("""WITH v AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY id)::INT AS version, id::VARCHAR AS spec FROM job_rows), c AS (SELECT c_custkey AS key FROM customer)
        SELECT c.key, 0::INT AS version, coalesce(v.spec, 'now') AS spec FROM c LEFT JOIN v ON v.key = c.key AND v.version = 2 UNION ALL SELECT key, version, CASE WHEN version = 2 AND key IN (SELECT key FROM c) THEN 'now' ELSE spec END FROM v""", "job_rows"),
    "k13_cascade": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 < 4)",
    "k14_age_delete": "SELECT coalesce(sum(length(response_json)), 0)::BIGINT AS freed, count(*) AS n FROM place_search_cache WHERE fetched_at < TIMESTAMPTZ '2024-06-01 00:00:00+00'",
    "k15_recover": "SELECT CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, count(*) AS n, sum(progress)::BIGINT AS progress FROM jobs GROUP BY 1",
    "t02_monotonic": with_views("SELECT event_id, max(progress) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM job_events", "job_events"),
    "t03_latest": with_views("SELECT key, event_id, kind FROM job_events QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1", "job_events"),
    "t05_state_fold": with_views("WITH e AS (SELECT key, ts, event_id, CASE WHEN event_id % 97 = 0 THEN 'canceled' ELSE kind END AS kind FROM job_events) SELECT key, CASE WHEN bool_or(kind = 'canceled') THEN 'canceled' ELSE arg_max(kind, (ts, event_id)) END AS state FROM e GROUP BY key", "job_events"),
    "t09_files_read": "SELECT 'orders' AS source, count(*) AS n FROM orders",
}
