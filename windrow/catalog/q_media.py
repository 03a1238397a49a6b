"""Text, path and metadata expressions over the text-bearing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.catalog import testbed as tb
from windrow.catalog.registry import query, rounded
from windrow.functions import media, numbers, text, times
from windrow.operators.selection import first_mapping
from windrow.session import spread


@query("room_parse", r"""WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Room ' || p_size || ' ' || p_name WHEN 1 THEN 'cam_room_' || p_size || '.png' WHEN 2 THEN 'ROOM-' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '/x' ELSE 'broom' || p_size END AS s FROM part)
SELECT p_partkey, CASE p_partkey * 0 + CAST(regexp_extract(s, '[0-9]+') AS BIGINT) % 4 WHEN 3 THEN 'unknown_room' ELSE 'room_' || CAST(regexp_extract(s, '[0-9]+') AS BIGINT) END AS room_id,
       CASE WHEN CAST(regexp_extract(s, '[0-9]+') AS BIGINT) % 4 = 3 THEN 'room_id_not_found' END AS warning FROM t""")
def room_parse(spark, sf):
    size = F.col("p_size")
    s = (
        F.when(size % 4 == 0, F.concat(F.lit("Room "), size.cast("string"), F.lit(" "), F.col("p_name")))
        .when(size % 4 == 1, F.concat(F.lit("cam_room_"), size.cast("string"), F.lit(".png")))
        .when(size % 4 == 2, F.concat(F.lit("ROOM-"), F.lpad(size.cast("string"), 3, "0"), F.lit("/x")))
        .otherwise(F.concat(F.lit("broom"), size.cast("string")))
    )
    df = tb.table(spark, sf, "part").select("p_partkey", text.room_id(s).alias("room_id"))
    return df.withColumn("warning", text.room_warning("room_id"))


@query("path_rooms", r"""WITH u AS (SELECT p_partkey, p_size, p_brand, 'video/Room ' || p_size || '/' || p_brand || '/clip.mp4' AS p FROM part)
SELECT p_partkey, 'room_' || p_size AS room_id, 'room_' || p_size || '_' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS session_id FROM u""")
def path_rooms(spark, sf):
    """Room and session read from a recording path."""
    path = F.concat(F.lit("video/Room "), F.col("p_size").cast("string"), F.lit("/"), F.col("p_brand"), F.lit("/clip.mp4"))
    df = tb.table(spark, sf, "part").select("p_partkey", path.alias("path")).withColumn("room_id", text.room_id_from_path("path"))
    return df.select("p_partkey", "room_id", text.session_id_from_path("path", "room_id").alias("session_id"))


@query("slug", r"""SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages""")
def slug(spark, sf):
    return tb.table(spark, sf, "pages").select("page_id", text.slug("url").alias("slug"))


@query("document_slugs", r"""SELECT doc_id, CASE WHEN trim(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9]+', '_', 'g'), '_') END AS slug FROM documents""")
def document_slugs(spark, sf):
    """Slugs of whole texts."""
    return tb.table(spark, sf, "documents").select("doc_id", text.slug("text").alias("slug"))


_DUR = """CASE l_linenumber % 4 WHEN 0 THEN CAST(l_quantity AS VARCHAR) || ' s' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || ':05:07.5' WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || ':09' ELSE 'none' END"""


@query("duration_parse", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * 3600 + 307.5 WHEN 2 THEN l_quantity * 60 + 9 END AS seconds FROM lineitem""")
def duration_parse(spark, sf):
    kind, whole = F.col("l_linenumber") % 4, F.col("l_quantity").cast("int").cast("string")
    raw = (
        F.when(kind == 0, F.concat(F.col("l_quantity").cast("string"), F.lit(" s")))
        .when(kind == 1, F.concat(whole, F.lit(":05:07.5")))
        .when(kind == 2, F.concat(whole, F.lit(":09")))
        .otherwise(F.lit("none"))
    )
    return rounded(tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", times.duration_seconds(raw).alias("seconds")))


@query("fraction_parse", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE round(l_extendedprice / (l_linenumber % 3 + 1), 6) END AS rate FROM lineitem""")
def fraction_parse(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    raw = F.when(F.col("l_linenumber") % 3 == 0, price).when(F.col("l_linenumber") % 3 == 1, F.concat(price, F.lit("/2"))).otherwise(F.concat(price, F.lit("/0")))
    return rounded(tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.fraction(raw).alias("rate")))


@query("time_texts", """SELECT o_orderkey, epoch_us(o_orderdate) + 10800000000 + (o_orderkey % 86400) * 1000000 AS instant_us, strftime(o_orderdate, '%Y-%m-%d') AS local_date,
CAST((o_orderkey % 86400) // 3600 AS BIGINT) AS local_hour, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%S') AS wall FROM orders""")
def time_texts(spark, sf):
    """Camera text with colon dates and an offset: instant, local date and hour."""
    wall = times.micros_ntz(times.ntz_micros("o_orderdate") + (F.col("o_orderkey") % 86_400) * 1_000_000)
    raw = F.concat(F.date_format(wall, "yyyy:MM:dd HH:mm:ss"), F.lit("-03:00"))
    local = times.local_time("raw")
    return rounded(tb.table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).select(
        "o_orderkey", times.instant_micros("raw").alias("instant_us"), F.date_format(local, "yyyy-MM-dd").alias("local_date"),
        F.hour(local).alias("local_hour"), times.iso_text(local).alias("wall"),
    ))


@query("excel_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""")
def excel_dates(spark, sf):
    """Half the dates as serial day numbers, half as text."""
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("string")
    raw = F.when(F.col("o_orderkey") % 2 == 0, serial).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return tb.table(spark, sf, "orders").select("o_orderkey", F.date_format(times.excel_date(raw), "yyyy-MM-dd").alias("date"))


@query("regex_first_match", """WITH m AS (SELECT * FROM (VALUES (1, '^small', 'tiny'), (2, 'WIDGET$', 'thing'), (3, 'r(e|o)d', 'rod'), (4, 'g.*o', 'go')) v(map_order, pattern, system_id)),
h AS (SELECT p_partkey, m.* FROM part JOIN m ON regexp_matches(p_name, '(?i)' || pattern))
SELECT p.p_partkey, b.system_id AS mapped_system_id, coalesce(c.n, 0) AS match_count FROM part p
LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY map_order) = 1) b USING (p_partkey) LEFT JOIN (SELECT p_partkey, count(*) AS n FROM h GROUP BY 1) c USING (p_partkey)""")
def regex_first_match(spark, sf):
    rules = spark.createDataFrame([(1, "^small", "tiny"), (2, "WIDGET$", "thing"), (3, "r(e|o)d", "rod"), (4, "g.*o", "go")], "map_order int, pattern string, system_id string")
    return first_mapping(tb.table(spark, sf, "part"), rules, "p_name", "p_partkey").select("p_partkey", "mapped_system_id", "match_count")


@query("probe_shape", """SELECT p_partkey, CAST(p_size * 10 AS BIGINT) AS width, round(p_retailprice / 1.001, 6) AS frame_rate, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(p_retailprice, 6) END AS duration_seconds,
p_size % 2 = 0 AS has_audio, CASE WHEN p_size % 2 = 0 THEN 48000 END AS audio_sample_rate, CASE WHEN p_size % 5 = 0 AND p_size % 2 = 1 THEN 'invalid_ffprobe_duration;no_embedded_audio_stream'
WHEN p_size % 5 = 0 THEN 'invalid_ffprobe_duration' WHEN p_size % 2 = 1 THEN 'no_embedded_audio_stream' ELSE '' END AS warnings FROM part""")
def probe_shape(spark, sf):
    """Probe documents built from the rows, read back into typed stream facts."""
    video = F.struct(
        F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), (F.col("p_size") * 10).cast("string").alias("width"), F.lit("720").alias("height"),
        F.concat((F.col("p_retailprice") * 1000).cast("decimal(18,3)").cast("string"), F.lit("/1001")).alias("avg_frame_rate"), F.lit(None).cast("string").alias("sample_rate"),
    )
    audio = F.struct(
        F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(None).cast("string").alias("width"), F.lit(None).cast("string").alias("height"),
        F.lit("0/0").alias("avg_frame_rate"), F.lit("48000").alias("sample_rate"),
    )
    streams = F.when(F.col("p_size") % 2 == 0, F.array(video, audio)).otherwise(F.array(video))
    length = F.when(F.col("p_size") % 5 == 0, F.lit("unknown")).otherwise(F.col("p_retailprice").cast("string"))
    doc = F.to_json(F.struct(streams.alias("streams"), F.struct(length.alias("duration")).alias("format")))
    parts = tb.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    # few bytes, much work a row: a file of a few splits would be a few tasks
    df = spread(parts, rows=tb.row_count(spark, sf, "part"), each=tb.DOCUMENTS_A_TASK).select("p_partkey", media.probe_fields(doc).alias("p"))
    return rounded(df.select("p_partkey", "p.width", "p.frame_rate", "p.duration_seconds", "p.has_audio", "p.audio_sample_rate", F.array_join("p.warnings", ";").alias("warnings")))


@query("path_layouts", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN lower(p_type) END AS system_id, CASE p_size % 3 WHEN 2 THEN 'room_' || p_size ELSE 'room_' || p_size END AS room_id,
regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS session_id, 'video' AS modality FROM part""")
def path_layouts(spark, sf):
    """Folders in three layouts; the modality folder tells equal depths apart."""
    room = F.concat(F.lit("Room "), F.col("p_size").cast("string"))
    path = (
        F.when(F.col("p_size") % 3 == 0, F.concat_ws("/", "p_type", room, "p_brand", F.lit("video"), F.lit("a.mp4")))
        .when(F.col("p_size") % 3 == 1, F.concat_ws("/", room, "p_brand", F.lit("video"), F.lit("a.mp4")))
        .otherwise(F.concat_ws("/", F.lit("video"), room, F.col("p_brand"), F.lit("a.mp4")))
    )
    df = tb.table(spark, sf, "part").select("p_partkey", media.path_context(path, "video").alias("c"))
    return df.select("p_partkey", "c.system_id", "c.room_id", "c.session_id", "c.modality")
