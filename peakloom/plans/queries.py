"""The queries of the engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codecs, columns
from ..functions import transforms as T
from ..operators import analysis, prefix, selection
from ..sources import container, mzml
from .session import ship
from .views import HEADERS_SQL as H
from .views import PEAKS_SQL as P
from .views import headers, peaks, signal, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

INDICES = "[0-9,50,100-120]"
SCANS = "[1-5,8,100-140]"
D16, D24, D32 = T.MZ_SCALES["delta16"], T.MZ_SCALES["delta24"], T.MZ_SCALES["delta32"]
C16 = float(T.f32(T.MZ_SCALES["cast16"]))
TOP = (1 << T.BITPACK_BITS) - 1
L = "(partition by user_id order by value, event_id)"
# The mass-bin polynomial, highest power first.
MASS_BIN = (2e-11, -2e-7, -0.0003, 6.3804, -3775.2)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def big(c):
    return c.cast("bigint")


# -- selection --------------------------------------------------------------------------------------------------------


@query(f"select scan, ms_level, rt_days from {H} where ms_level = 1")
def filter_level(spark, d):
    return selection.by_level(headers(spark, d), 1).select("scan", "ms_level", "rt_days")


@query(f"select scan, ms_level, rt_days from {H} where ms_level > 2")
def filter_level_n(spark, d):
    return selection.by_level(headers(spark, d), "n").select("scan", "ms_level", "rt_days")


@query(f"""select i as "index", scan, ms_level from (select *, cast(row_number() over (order by scan) - 1 as bigint) i from {H})
where i between 0 and 9 or i = 50 or i between 100 and 120""")
def filter_index(spark, d):
    rows = prefix.global_index(headers(spark, d).select("scan", "ms_level"), "scan")
    return selection.select_spectra(rows, indices=INDICES).select("index", "scan", "ms_level")


@query(f"select scan, ms_level from {H} where scan in (select user_id from events)")
def filter_scan(spark, d):
    wanted = signal(spark, d).select(F.col("user_id").alias("scan"))
    return selection.by_scans(headers(spark, d).select("scan", "ms_level"), wanted)


@query("select distinct event_id * 3 as scan from events where not exists (select 1 from orders where o_orderkey = event_id * 3)")
def missing_scans_anti(spark, d):
    wanted = signal(spark, d).select((F.col("event_id") * 3).alias("scan"))
    return selection.missing_scans(headers(spark, d).select("scan"), wanted)


@query(f"select scan, ms_level from {H} where scan between 1 and 5 or scan = 8 or scan between 100 and 140")
def range_list(spark, d):
    return selection.select_spectra(headers(spark, d).select("scan", "ms_level"), scans=SCANS)


@query(f"select scan, ms_level from {H} where scan in (select unnest(range(0, 300)) * 7)")
def range_list_long(spark, d):
    ranges = [(7 * k, 7 * k) for k in range(300)]  # too many for a predicate: a semi join
    return selection.by_ranges(headers(spark, d).select("scan", "ms_level"), "scan", ranges)


@query(f"select scan, l_partkey, mz, intensity from (select *, row_number() over (partition by scan order by l_partkey, l_suppkey, l_linenumber, mz, l_shipdate) rn from {P}) where rn = 1")
def first_match(spark, d):
    order = ["l_partkey", "l_suppkey", "l_linenumber", "mz", "l_shipdate"]
    return selection.first_match(peaks(spark, d), "scan", order).select("scan", "l_partkey", "mz", "intensity")


@query(f"""select scan, mz, intensity, cast(rn as int) as rank from (
  select *, row_number() over (partition by scan order by intensity desc, mz, l_partkey, l_suppkey, l_linenumber, l_shipdate) rn from {P}) where rn <= 3""")
def top_peaks(spark, d):
    order = [F.desc("intensity"), F.col("mz"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_shipdate")]
    return selection.top_k(peaks(spark, d), "scan", order, 3).select("scan", "mz", "intensity", "rank")


@query("select page_id, cast(octet_length(encode(html)) as bigint) as n_bytes from pages where octet_length(encode(html)) > 0")
def skip_empty(spark, d):
    return table(spark, d, "pages").where(F.octet_length("html") > 0).select("page_id", big(F.octet_length("html")).alias("n_bytes"))


# -- aggregates -------------------------------------------------------------------------------------------------------


@query(f"select case when ms_level > 2 then 'MSn' else concat('MS', cast(ms_level as varchar)) end as level, count(*) as n from {H} group by 1")
def level_counts(spark, d):
    return headers(spark, d).groupBy(columns.level_bucket(F.col("ms_level")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select ms_level, status, cast(grouping_id(ms_level, status) as bigint) as gid, count(*) as n from {H} group by rollup(ms_level, status)")
def level_rollup(spark, d):
    return headers(spark, d).rollup("ms_level", "status").agg(big(F.grouping_id()).alias("gid"), F.count(F.lit(1)).alias("n"))


@query(f"select ms_level, status, cast(grouping_id(ms_level, status) as bigint) as gid, count(*) as n from {H} group by cube(ms_level, status)")
def level_cube(spark, d):
    return headers(spark, d).cube("ms_level", "status").agg(big(F.grouping_id()).alias("gid"), F.count(F.lit(1)).alias("n"))


@query(f"select count(distinct scan) as n_scans from {P}")
def distinct_scans(spark, d):
    return peaks(spark, d).agg(F.countDistinct("scan").alias("n_scans"))


@query()
def distinct_scans_approx(spark, d):
    return peaks(spark, d).agg(F.approx_count_distinct("scan", 0.02).alias("n_scans"))


@query(f"""select h.scan, rt_days, cast(sum(cast(round(intensity * 100) as bigint)) as bigint) as tic_cents, max(intensity) as base_peak, count(*) as n_peaks
from {H} h join {P} p on h.scan = p.scan where ms_level = 1 group by 1, 2""")
def tic(spark, d):
    first = selection.by_level(headers(spark, d), 1).select("scan", "rt_days")
    return analysis.total_and_base(peaks(spark, d).select("scan", "intensity").join(first, "scan"), ["scan", "rt_days"])


@query(f"select rt_days, max(intensity) as bpc, cast(sum(cast(round(intensity * 100) as bigint)) as bigint) as tic_cents from {H} h join {P} p on h.scan = p.scan where ms_level = 1 group by 1")
def bpc(spark, d):
    first = selection.by_level(headers(spark, d), 1).select("scan", "rt_days")
    out = analysis.total_and_base(peaks(spark, d).select("scan", "intensity").join(first, "scan"), ["rt_days"])
    return out.select("rt_days", F.col("base_peak").alias("bpc"), "tic_cents")


@query("select vec_id, greatest(cast(0 as float), list_max(embedding)) as base_peak, cast(len(embedding) as bigint) as size from embeddings")
def base_peak(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.greatest(F.lit(0).cast("float"), F.array_max("embedding")).alias("base_peak"), big(F.size("embedding")).alias("size"))


@query("select user_id, max(diff) as max_diff from (select user_id, value - lag(value) over (partition by user_id order by ts, event_id) diff from events) group by 1")
def max_diff(spark, d):
    rows = analysis.deltas(signal(spark, d), "user_id", ["ts", "event_id"], "value")
    return rows.groupBy("user_id").agg(F.max(F.col("value") - F.col("previous")).alias("max_diff"))


@query("select lang, cast(sum(octet_length(encode(text))) as bigint) as n_bytes, count(*) as n from documents group by 1")
def stream_bytes(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(big(F.octet_length("text"))).alias("n_bytes"), F.count(F.lit(1)).alias("n"))


@query(f"""with n as (select count(*) c from {H}), r as (select *, row_number() over (order by scan) - 1 rn from {H})
select cast(least(6, floor(rn / floor(c / 7))) as int) as division_id, count(*) as n, cast(sum(scan) as bigint) as size, max(scan) as last_scan from r, n group by 1""")
def division_stats(spark, d):
    rows = prefix.equal_count_divisions(headers(spark, d).select("scan"), "scan", 7)
    return rows.groupBy("division_id").agg(F.count(F.lit(1)).alias("n"), F.sum("scan").alias("size"), F.max("scan").alias("last_scan"))


@query()
def compression_ratio(spark, d):
    ship(spark)
    docs = table(spark, d, "documents").select("lang", F.col("text").cast("binary").alias("raw"))
    out = docs.select("lang", F.length("raw").alias("size"), F.length(codecs.compress_udf("zstd")(F.col("raw"))).alias("packed"))
    return out.groupBy("lang").agg(F.sum("size").alias("original"), F.sum("packed").alias("compressed"), F.round(F.sum("size") / F.sum("packed"), 3).alias("ratio"))


@query("""select doc_id, cast(floor(before / 100000) as int) as division_id from (
  select doc_id, sum(octet_length(encode(text))) over (order by doc_id rows between unbounded preceding and current row) - octet_length(encode(text)) before from documents)""")
def divisions_by_bytes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return prefix.byte_divisions(docs, "doc_id", big(F.col("n")), 100_000).select("doc_id", "division_id")


# -- windows and positions --------------------------------------------------------------------------------------------


@query(f'select scan, cast(row_number() over (order by scan) - 1 as bigint) as "index" from {H}')
def spectrum_index(spark, d):
    return prefix.global_index(headers(spark, d).select("scan"), "scan")


@query(f"""with n as (select count(*) c from {H}), r as (select scan, row_number() over (order by scan) - 1 rn from {H})
select scan, cast(least(15, floor(rn / floor(c / 16))) as int) as division_id from r, n""")
def divisions_assign(spark, d):
    return prefix.equal_count_divisions(headers(spark, d).select("scan"), "scan", 16)


@query("""select doc_id, cast(octet_length(encode(text)) as bigint) as size,
  cast(sum(octet_length(encode(text))) over (order by doc_id rows between unbounded preceding and current row) - octet_length(encode(text)) as bigint) as "offset" from documents""")
def block_offsets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", big(F.octet_length("text")).alias("size"))
    return prefix.running_total(docs, "doc_id", F.col("size"), "offset")


@query(f"select event_id, lead(value) over {L} as next_value from events")
def next_start(spark, d):
    w = W.partitionBy("user_id").orderBy("value", "event_id")
    return signal(spark, d).select("event_id", F.lead("value").over(w).alias("next_value"))


@query("""select user_id, coalesce(bool_and(up), true) as increasing, count(*) as n from (
  select user_id, value > lag(value) over (partition by user_id order by ts, event_id) up from events) group by 1""")
def monotonic_check(spark, d):
    rows = analysis.deltas(signal(spark, d), "user_id", ["ts", "event_id"], "value")
    return rows.groupBy("user_id").agg(F.coalesce(F.bool_and(F.col("value") > F.col("previous")), F.lit(True)).alias("increasing"), F.count(F.lit(1)).alias("n"))


@query("""select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (
  partition by user_id order by ts, event_id rows between unbounded preceding and current row) as carried from events""")
def carry_forward(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return analysis.carry_forward(signal(spark, d), "user_id", ["ts", "event_id"], value, "carried").select("event_id", "carried")


@query('select user_id, cast(sum(n) over (order by user_id) - n as bigint) as first, cast(sum(n) over (order by user_id) as bigint) as "end" from (select user_id, count(*) n from events group by 1)')
def index_dict(spark, d):
    return analysis.row_ranges(signal(spark, d), "user_id")


@query(f"select event_id, cast(sum(cast(round(value * 100) as bigint)) over (partition by user_id order by value, event_id rows between unbounded preceding and current row) as bigint) as cum_cents from events")
def cumulative_intensity(spark, d):
    w = W.partitionBy("user_id").orderBy("value", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return signal(spark, d).select("event_id", F.sum(big(F.round(F.col("value") * 100))).over(w).alias("cum_cents"))


# -- array transforms -------------------------------------------------------------------------------------------------


def _steps(spark, d):
    return analysis.deltas(signal(spark, d).select("event_id", "user_id", "value"), "user_id", ["value", "event_id"], "value")


def _delta_sql(scale, width):
    return f"select event_id, least({(1 << width) - 1}, cast(floor((value - lag(value) over {L}) * {scale!r}::double) as bigint)) as q from events"


@query(f"select event_id, case when p is null then null else {'least(65535, cast(floor((value - p) * ' + repr(D16) + '::double) as bigint))'} end as q from (select *, lag(value) over {L} p from events)")
def delta16(spark, d):
    return _steps(spark, d).select("event_id", F.when(F.col("previous").isNotNull(), T.delta_column(F.col("value"), F.col("previous"), D16, 16)).alias("q"))


@query(f"select event_id, case when p is null then null else least(16777215, cast(floor((value - p) * {D24!r}::double) as bigint)) end as q from (select *, lag(value) over {L} p from events)")
def delta24(spark, d):
    return _steps(spark, d).select("event_id", F.when(F.col("previous").isNotNull(), T.delta_column(F.col("value"), F.col("previous"), D24, 24)).alias("q"))


@query(f"select event_id, cast(floor(cast(value - p as float) * cast({D32!r} as float)) as bigint) as q from (select *, lag(value) over {L} p from events)")
def delta32(spark, d):
    return _steps(spark, d).select("event_id", T.delta32_column(F.col("value"), F.col("previous"), D32).alias("q"))


@query(f"""select vec_id, cast(pos - 1 as int) as pos, a[pos] - a[pos - 1] as diff from (
  select vec_id, list_sort(embedding) a, unnest(range(2, len(embedding) + 1)) pos from embeddings)""")
def array_delta(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.sort_array("embedding").alias("a"))
    return v.select("vec_id", F.posexplode(T.array_delta_column(F.col("a"))).alias("p", "diff")).select("vec_id", (F.col("p") + 1).alias("pos"), "diff")


def _vdelta(spark, d, width):
    rows = _steps(spark, d)
    most = rows.groupBy("user_id").agg(F.max(F.col("value") - F.col("previous")).alias("most"))
    rows = rows.join(most, "user_id").withColumn("scale", T.adaptive_scale_column(F.col("most"), width))
    q = big(F.floor((F.col("value") - F.col("previous")) * F.col("scale").cast("double")))
    return rows.select("event_id", F.least(F.lit((1 << width) - 1).cast("bigint"), q).alias("q") if width == 24 else q.alias("q"))


def _vdelta_sql(width, clip):
    q = "cast(floor((value - p) * cast(scale as double)) as bigint)"
    q = f"case when p is null then null else least({(1 << width) - 1}, {q}) end" if clip else q
    return f"""with s as (select *, lag(value) over {L} p from events),
m as (select user_id, max(value - p) most from s group by 1),
c as (select user_id, case when most > 0 then cast(cast({(1 << width) - 1} as float) / cast(most as float) as float) else cast(1 as float) end scale from m)
select event_id, {q} as q from s join c using (user_id)"""


@query(_vdelta_sql(16, False))
def vdelta16(spark, d):
    return _vdelta(spark, d, 16)


@query(_vdelta_sql(24, True))
def vdelta24(spark, d):
    rows = _steps(spark, d)
    out = _vdelta(spark, d, 24)
    return out.join(rows.select("event_id", "previous"), "event_id").select("event_id", F.when(F.col("previous").isNotNull(), F.col("q")).alias("q"))


@query(f"""with s as (select event_id, user_id, value, cast(floor((value - lag(value) over {L}) * {D24!r}::double) as bigint) q from events)
select event_id, round(first_value(value) over {L} + coalesce(cast(sum(q) over {L} as bigint), 0) / {D24!r}::double, 6) as restored from s""")
def delta_decode(spark, d):
    rows = _steps(spark, d).withColumn("q", big(F.floor((F.col("value") - F.col("previous")) * D24)))
    w = W.partitionBy("user_id").orderBy("value", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("event_id", F.round(F.first("value").over(w) + F.coalesce(F.sum("q").over(w), F.lit(0)) / F.lit(D24), 6).alias("restored"))


@query("select event_id, cast(floor(log2(value + 1) * 72) as bigint) as q from events")
def log_transform(spark, d):
    return signal(spark, d).select("event_id", T.log_column(F.col("value"), 72.0).alias("q"))


@query("select event_id, round(power(2, cast(floor(log2(value + 1) * 72) as bigint) / 72.0::double) - 1, 6) as restored from events")
def log_inverse(spark, d):
    q = T.log_column(F.col("value"), 72.0)
    return signal(spark, d).select("event_id", F.round(T.log_inverse_column(q, 72.0), 6).alias("restored"))


@query("select event_id, cast(cast(value as float) as double) as q from events")
def cast32(spark, d):
    return signal(spark, d).select("event_id", T.cast32_column(F.col("value")).alias("q"))


@query(f"select event_id, least(65535, cast(floor(value * {C16!r}::double) as bigint)) as q from events")
def cast16(spark, d):
    return signal(spark, d).select("event_id", T.cast16_column(F.col("value"), C16).alias("q"))


@query(f"select event_id, round(least(65535, cast(floor(value * {C16!r}::double) as bigint)) / {C16!r}::double, 6) as restored from events")
def cast16_inverse(spark, d):
    return signal(spark, d).select("event_id", F.round(T.cast16_column(F.col("value"), C16) / F.lit(C16), 6).alias("restored"))


def _peaked(spark, d):
    rows = signal(spark, d).select("event_id", "user_id", "value")
    peak = rows.groupBy("user_id").agg(F.max("value").alias("bp"))
    return rows.join(peak, "user_id").withColumn("nb", T.bits_column(F.col("bp"), 1.0))


_VBR = """with m as (select user_id, max(value) bp, greatest(2, cast(ceil(log2(max(value) / 1.0::double + 1)) as int)) nb from events group by 1),
q as (select event_id, bp, nb, cast(floor(value / bp * (power(2, nb) - 1)) as bigint) q from events join m using (user_id))"""


@query(_VBR + " select event_id, nb, q from q")
def vbr(spark, d):
    return _peaked(spark, d).select("event_id", "nb", T.vbr_column(F.col("value"), F.col("bp"), F.col("nb")).alias("q"))


@query(_VBR + " select event_id, round(q * bp / (power(2, nb) - 1), 6) as restored from q")
def vbr_inverse(spark, d):
    rows = _peaked(spark, d).withColumn("q", T.vbr_column(F.col("value"), F.col("bp"), F.col("nb")))
    return rows.select("event_id", F.round(T.vbr_inverse_column(F.col("q"), F.col("bp"), F.col("nb")), 6).alias("restored"))


@query(f"select event_id, cast(floor(least(1.0::double, value / 10000.0::double) * {TOP}.0::double) as bigint) as q from events")
def bitpack(spark, d):
    return signal(spark, d).select("event_id", T.bitpack_column(F.col("value"), 10000.0).alias("q"))


@query(f"select event_id, round(cast(floor(least(1.0::double, value / 10000.0::double) * {TOP}.0::double) as bigint) * 10000.0::double / {TOP}.0::double, 6) as restored from events")
def bitpack_inverse(spark, d):
    q = T.bitpack_column(F.col("value"), 10000.0)
    return signal(spark, d).select("event_id", F.round(T.bitpack_inverse_column(q, 10000.0), 6).alias("restored"))


@query(f"""select 'cast' as transform, round(max(abs(value - cast(cast(value as float) as double))), 6) as max_error from events
union all select 'cast16', round(max(abs(value - least(65535, floor(value * {C16!r}::double)) / {C16!r}::double)), 6) from events
union all select 'log', round(max(abs(value - (power(2, floor(log2(value + 1) * 72) / 72.0::double) - 1))), 6) from events
union all select 'bitpack', round(max(abs(value - floor(least(1.0::double, value / 10000.0::double) * {TOP}.0::double) * 10000.0::double / {TOP}.0::double)), 6) from events""")
def transform_error(spark, d):
    v = F.col("value")
    back = {"cast": T.cast32_column(v), "cast16": T.cast16_column(v, C16) / F.lit(C16), "log": T.log_inverse_column(T.log_column(v, 72.0), 72.0), "bitpack": T.bitpack_inverse_column(T.bitpack_column(v, 10000.0), 10000.0)}
    once = signal(spark, d).agg(*[F.round(F.max(F.abs(v - b)), 6).alias(k) for k, b in back.items()])
    return once.select(F.explode(F.array(*[F.struct(F.lit(k).alias("transform"), F.col(k).alias("max_error")) for k in back])).alias("r")).select("r.*")


@query()
def codec_error(spark, d):
    """Every codec, packed and unpacked in Arrow functions on sorted vectors: the largest error, and bytes a value."""
    ship(spark)
    rows = table(spark, d, "embeddings").select(F.transform(F.sort_array("embedding"), lambda x: (x.cast("double") + 1) * 200).alias("a"))
    parts = []
    for name in T.TRANSFORMS:
        one = rows.select("a", T.encode_udf(name)(F.col("a")).alias("p")).select("a", F.length("p").alias("n"), T.decode_udf(name)(F.col("p")).alias("b"))
        error = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
        parts.append(one.agg(F.lit(name).alias("transform"), F.round(F.max(error), 6).alias("max_error"), F.round(F.sum("n") / F.sum(F.size("a")), 3).alias("bytes_a_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_EXPLODED = "select vec_id, cast(pos - 1 as int) as pos, cast(embedding[pos] as double) as v from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) pos from embeddings)"


@query(_EXPLODED)
def roundtrip_lossless(spark, d):
    """Payload, zstd block and back."""
    ship(spark)
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    rows = rows.select("vec_id", T.encode_udf("lossless")(F.col("a")).alias("p")).select("vec_id", F.length("p").alias("n"), codecs.compress_udf("zstd")(F.col("p")).alias("z"))
    back = rows.select("vec_id", T.decode_udf("lossless")(codecs.decompress_udf("zstd")(F.col("z"), F.col("n"))).alias("a"))
    return back.select("vec_id", F.posexplode("a").alias("pos", "v"))


@query(_EXPLODED)
def roundtrip_lz4(spark, d):
    ship(spark)
    rows = table(spark, d, "embeddings").select("vec_id", T.encode_udf("lossless")(F.col("embedding").cast("array<double>")).alias("p"))
    rows = rows.select("vec_id", F.length("p").alias("n"), codecs.compress_udf("lz4")(F.col("p")).alias("z"))
    back = rows.select("vec_id", T.decode_udf("lossless")(codecs.decompress_udf("lz4")(F.col("z"), F.col("n"))).alias("a"))
    return back.select("vec_id", F.posexplode("a").alias("pos", "v"))


@query(_EXPLODED)
def decode_arrays(spark, d):
    """The text of a <binary> element (base64, zlib) and back."""
    ship(spark)
    rows = table(spark, d, "embeddings").select("vec_id", codecs.encode_binary_udf("<f4", codecs.ZLIB)(F.col("embedding")).alias("t"))
    return rows.select("vec_id", F.posexplode(codecs.decode_binary_udf("<f4", codecs.ZLIB)(F.col("t"))).alias("pos", "v"))


@query("select doc_id, to_base64(encode(text)) as b64, text as restored from documents")
def base64_roundtrip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("b64"))
    return rows.select("doc_id", F.regexp_replace("b64", "[\r\n]", "").alias("b64"), F.decode(F.unbase64("b64"), "UTF-8").alias("restored"))


# -- peaks, pieces, joins ---------------------------------------------------------------------------------------------


@query("select vec_id, label, cast(pos - 1 as int) as pos, embedding[pos] as v from (select *, unnest(range(1, len(embedding) + 1)) pos from embeddings)")
def peaks_explode(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))


@query("select vec_id, cast(pos - 1 as int) as pos, embedding[pos] as mz, abs(embedding[pos]) as intensity from (select *, unnest(range(1, len(embedding) + 1)) pos from embeddings)")
def peaks_zip(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("mz"), F.transform("embedding", F.abs).alias("intensity"))
    whole = v.where(F.assert_true(F.size("mz") == F.size("intensity"), F.lit("m/z and intensity differ in length")).isNull())
    return whole.select("vec_id", F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p")).select("vec_id", "pos", "p.mz", "p.intensity")


@query("select vec_id, v from (select vec_id, unnest(list_filter(embedding, lambda x: x > 0.1)) v from embeddings)")
def array_filter(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.explode(F.filter("embedding", lambda x: x > 0.1)).alias("v"))


@query("select doc_id, md5(text) as md5, 4 as n_chunks from documents")
def external_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    pieces = analysis.chunks(docs, "doc_id", "content", 4).select("doc_id", "chunk", F.hex("piece").alias("piece"))
    whole = analysis.interleave(pieces, "doc_id", ["chunk"])
    counted = whole.join(pieces.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_chunks")), "doc_id")
    return counted.select("doc_id", F.md5(F.unhex("text")).alias("md5"), "n_chunks")


@query("select page_id, cast(instr(html, '<title>') as bigint) as start, cast(instr(html, '</title>') as bigint) as stop from pages")
def text_positions(spark, d):
    return table(spark, d, "pages").select("page_id", big(F.instr("html", "<title>")).alias("start"), big(F.instr("html", "</title>")).alias("stop"))


@query("select page_id, substr(html, instr(html, '<title>') + 7, instr(html, '</title>') - instr(html, '<title>') - 7) as title from pages where instr(html, '</title>') > instr(html, '<title>')")
def header_extract(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("html"), F.instr("html", "<title>").alias("a"), F.instr("html", "</title>").alias("b")).where("b > a")
    return p.select("page_id", F.substring(F.col("html"), F.col("a") + 7, F.col("b") - F.col("a") - 7).alias("title"))


@query("""with iv as (select page_id, page_id * 10 as lo, page_id * 10 + instr(html, '</title>') as hi from pages), pt as (select vec_id, vec_id * 7 as pt from embeddings)
select vec_id, page_id from pt join iv on pt >= lo and pt < hi""")
def interval_join(spark, d):
    iv = table(spark, d, "pages").select("page_id", (F.col("page_id") * 10).alias("lo"), (F.col("page_id") * 10 + F.instr("html", "</title>")).alias("hi"))
    pt = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") * 7).alias("pt"))
    return analysis.interval_join(pt, iv, "pt", "lo", "hi", 128).select("vec_id", "page_id")


@query("""with n as (select conv_id, count(*) c from conversations group by 1), r as (select conv_id, sum(c) over (order by conv_id) - c lo, sum(c) over (order by conv_id) hi from n)
select vec_id, conv_id, cast(vec_id - lo as bigint) as ord from embeddings join r on vec_id >= lo and vec_id < hi""")
def range_join_division(spark, d):
    ranges = analysis.row_ranges(table(spark, d, "conversations"), "conv_id", "lo", "hi")
    rows = analysis.interval_join(table(spark, d, "embeddings").select("vec_id"), ranges, "vec_id", "lo", "hi", 64)
    return rows.select("vec_id", "conv_id", (F.col("vec_id") - F.col("lo")).alias("ord"))


@query("""select doc_id, md5(concat(lang, source, lang, cast(n_chars as varchar))) as md5 from documents""")
def interleave_streams(spark, d):
    docs = table(spark, d, "documents")
    slot = lambda k, c: docs.select("doc_id", F.lit(k).alias("slot"), F.col(c).cast("string").alias("piece"))
    pieces = slot(0, "lang").union(slot(1, "source")).union(slot(2, "lang")).union(slot(3, "n_chars"))
    return analysis.interleave(pieces, "doc_id", ["slot"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query(f"select status, scan from {H}")
def flatten_divisions(spark, d):
    h = headers(spark, d).select("status", "scan")
    parts = [h.where(F.col("status") == s) for s in ("F", "O")] + [h.where(~F.col("status").isin("F", "O"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(f"""select cast(0 as int) as part, cast(-1 as bigint) as ord, 'header' as line union all
select 1, scan, concat('scan=', cast(scan as varchar)) from {H} where ms_level = 2 union all select 2, cast(-1 as bigint), 'footer'""")
def extract_union(spark, d):
    edge = lambda k, t: spark.createDataFrame([(k, -1, t)], "part int, ord bigint, line string")
    rows = selection.by_level(headers(spark, d), 2).select(F.lit(1).alias("part"), F.col("scan").alias("ord"), F.concat(F.lit("scan="), F.col("scan").cast("string")).alias("line"))
    return edge(0, "header").unionAll(rows).unionAll(edge(2, "footer"))


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def accession_dim_join(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    names = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return c.join(names, c.c_nationkey == names.n_nationkey).select("c_custkey", "n_name", "r_name")


@query("select n_nationkey, concat('MS:', cast(1000000 + n_nationkey as varchar)) as label, cast(1000000 + n_nationkey as int) as code, n_name from nation")
def accession_label(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", columns.accession_label(F.lit(1000000) + F.col("n_nationkey")).alias("label"), "n_name")
    return n.select("n_nationkey", "label", columns.accession_code(F.col("label")).alias("code"), "n_name")


@query(f"""select count(*) as n_rows, cast(0 as bigint) as only_left, cast(0 as bigint) as only_right,
  cast(sum(cast(abs(value - least(65535, floor(value * {C16!r}::double)) / {C16!r}::double) > 0.08 as int)) as bigint) as value_apart from events""")
def validate_tolerance(spark, d):
    rows = signal(spark, d).select("event_id", "value")
    back = rows.select("event_id", (T.cast16_column(F.col("value"), C16) / F.lit(C16)).alias("value"))
    return analysis.validate(rows, back, ["event_id"], {"value": 0.08})


@query("select round_even(value, 0) as mz_bin, cast(user_id % 10 as int) as rt_bin, round(cbrt(sum(ln(value))), 6) as cell, count(*) as n from events group by 1, 2")
def tic_heatmap(spark, d):
    return analysis.heat_map(signal(spark, d), F.bround("value", 0), (F.col("user_id") % 10).cast("int"), F.col("value"))


EVENT_TYPES = ("click", "view", "purchase", "error", "signup")


@query("select user_id, " + ", ".join(f"""cast(sum(c) filter (event_type = '{t}') as bigint) as "{t}\"""" for t in EVENT_TYPES) + " from (select *, cast(round(value * 100) as bigint) c from events) group by 1")
def tic_pivot(spark, d):
    rows = signal(spark, d).select("user_id", "event_type", big(F.round(F.col("value") * 100)).alias("c"))
    return rows.groupBy("user_id").pivot("event_type", list(EVENT_TYPES)).agg(F.sum("c"))


_POLY = "((((2e-11::double * x + -2e-7::double) * x + -0.0003::double) * x + 6.3804::double) * x + -3775.2::double)"


@query(f"select scan, cast(greatest(0, floor({_POLY} / 5)) as int) as mass_bin from (select scan, price / 200 as x from {H})")
def mass_bin(spark, d):
    return headers(spark, d).select("scan", columns.mass_bin(F.col("price") / 200, MASS_BIN).alias("mass_bin"))


@query(f"select scan, count(*) as n_peaks, count(distinct l_partkey) as n_parts, min(mz) as low, max(mz) as high from {P} group by 1 having count(*) > 5")
def spectrum_summary(spark, d):
    g = peaks(spark, d).groupBy("scan").agg(F.count(F.lit(1)).alias("n_peaks"), F.countDistinct("l_partkey").alias("n_parts"), F.min("mz").alias("low"), F.max("mz").alias("high"))
    return g.where("n_peaks > 5")


# -- scalar functions -------------------------------------------------------------------------------------------------


@query("""select p_partkey, cast(p_size::bigint * case p_partkey % 4 when 0 then 1000 when 1 then 1000000 when 2 then 1000000000 else 0 end + case when p_partkey % 4 = 3 then -1 else 0 end as bigint) as bytes from part""")
def blocksize_parse(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, ("KB", "MB", "GB", "XB"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", columns.block_size(F.concat(F.col("p_size").cast("string"), suffix)).alias("bytes"))


_H = "cast(floor((x * 100 + {u} // 2) / {u}) as bigint)"


def _human(unit, name):
    h = f"cast((x * 100 + {unit // 2}) // {unit} as bigint)" if unit > 1 else "x * 100"
    return f"""concat(cast({h} // 100 as varchar), case when {h} % 100 = 0 then '' when {h} % 10 = 0 then concat('.', cast({h} % 100 // 10 as varchar)) else concat('.', lpad(cast({h} % 100 as varchar), 2, '0')) end, ' {name}')"""


@query(f"""select doc_id, case when x < 1024 then {_human(1, 'Bytes')} when x < 1048576 then {_human(1 << 10, 'KB')} else {_human(1 << 20, 'MB')} end as human
from (select doc_id, cast(octet_length(encode(text)) as bigint) * (doc_id % 50 + 1) x from documents)""")
def format_bytes(spark, d):
    size = big(F.octet_length("text")) * (F.col("doc_id") % 50 + 1)
    return table(spark, d, "documents").select("doc_id", columns.format_bytes(size).alias("human"))


@query("select p_partkey, case when length(t) <= 12 then t else concat(substr(t, 1, 5), '...', right(t, 4)) end as short from (select p_partkey, concat(p_name, ' ', p_brand) t from part)")
def smart_trim(spark, d):
    return table(spark, d, "part").select("p_partkey", columns.smart_trim(F.concat("p_name", F.lit(" "), "p_brand"), 12).alias("short"))


@query(r"""select p_partkey, case p_partkey % 3
  when 0 then concat(replace(p_name, ' ', '_'), '.msz') when 1 then replace(p_name, ' ', '_') else concat(replace(p_name, ' ', '_'), '.txt.msz') end as output from part""")
def output_name(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    kind = F.element_at(F.array(*map(F.lit, ("document", "container", "external"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.concat(name, F.element_at(F.array(*map(F.lit, (".mzML", ".msz", ".txt"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", columns.output_name(path, kind).alias("output"))


@query("select page_id, case when page_id % 3 = 0 then 'document' when page_id % 3 = 1 then 'container' else 'external' end as kind from pages")
def file_type_sniff(spark, d):
    body = F.col("html").cast("binary")
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(f"<?xml?>\n<{columns.INDEXED_MARK}>".encode()), body))
    content = content.when(F.col("page_id") % 3 == 1, F.concat(F.lit(columns.CONTAINER_MAGIC.to_bytes(4, "little")), body)).otherwise(body)
    return table(spark, d, "pages").select("page_id", columns.file_type(content).alias("kind"))


@query(f"select count(*) as num_spectra, cast(sum(price) as bigint) as original_filesize, cast(4 as int) as n_divisions, cast({columns.CONTAINER_MAGIC} as int) as magic_tag, min(scan) as first_scan, max(scan) as last_scan from (select scan, cast(round(price) as bigint) price from {H})")
def describe_footer(spark, d):
    h = headers(spark, d)
    return h.agg(
        F.count(F.lit(1)).alias("num_spectra"), F.sum(big(F.round("price"))).alias("original_filesize"), F.lit(4).alias("n_divisions"), F.lit(columns.CONTAINER_MAGIC).alias("magic_tag"),
        F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"),
    )


@query("select date_trunc('hour', ts) as hour_start, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as tic_cents from events group by 1")
def tic_tumbling(spark, d):
    rows = signal(spark, d).groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour_start"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(big(F.round(F.col("value") * 100))).alias("tic_cents"))


# -- documents and containers: orders are spectra, their lines are peaks, 4,000 order keys make a file ------------------

_FILE = "cast(scan // 4000 as bigint)"
_STORED = f"""(select h.scan, {_FILE.replace('scan', 'h.scan')} as file, dense_rank() over (partition by {_FILE.replace('scan', 'h.scan')} order by h.scan) - 1 as index,
  row_number() over (partition by h.scan order by mz, l_linenumber) - 1 as pos, ms_level, rt_days, mz, intensity from {H} h join {P} p on h.scan = p.scan)"""
#: What is looked up by index in each file: both ends of its first and second block, and more.
LOOKUP = [0, 1, 2, 40, 499, 500, 777, 1000]
_LOOKED = f"index in ({', '.join(map(str, LOOKUP))})"
#: What the queries use of a document's spectra.
_READ = ("file", "index", "scan", "ms_level", "retention_time", "mz", "intensity")
#: Small blocks, so that files have several.
_OPTIONS = container.Options(blocksize=200_000)


def documents_from_tables(spark, d, **options):
    """(path, content) of documents."""
    own = peaks(spark, d).groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("mz", "l_linenumber", "intensity"))).alias("p"))
    rows = headers(spark, d).join(own, "scan").select("scan", "ms_level", F.col("rt_days").cast("double").alias("retention_time"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
    return mzml.documents_of(rows.withColumn("file", F.floor(F.col("scan") / 4000).cast("bigint")), "file", compression=codecs.ZLIB)


def _stored_peaks(spectra, *more):
    rows = spectra.select(F.col("file").cast("bigint").alias("file"), big(F.col("index")).alias("index"), big(F.col("scan")).alias("scan"), F.col("ms_level").cast("int").alias("ms_level"), *more, F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p"))
    return rows.select("file", "index", "scan", "ms_level", *[c for c in rows.columns if c == "rt_days"], big(F.col("pos")).alias("pos"), "p.mz", "p.intensity")


_COLUMNS = "file, cast(index as bigint) as index, scan, ms_level, cast(pos as bigint) as pos, mz, cast(intensity as double) as intensity"


@query(f"select file, cast(index as bigint) as index, scan, ms_level, rt_days, cast(pos as bigint) as pos, mz, cast(intensity as double) as intensity from {_STORED}")
def mzml_roundtrip(spark, d):
    """Documents written on executors and read again."""
    return _stored_peaks(mzml.spectra_of(documents_from_tables(spark, d), _READ), F.col("retention_time").cast("bigint").alias("rt_days"))


@query(f"select {_COLUMNS} from {_STORED}")
def container_roundtrip(spark, d):
    """Documents compressed into containers and read from there."""
    return _stored_peaks(container.spectra_of(container.compress_contents(documents_from_tables(spark, d), _OPTIONS)))


@query(f"select {_COLUMNS} from {_STORED}")
def container_decompress(spark, d):
    """Containers made documents again, and those read."""
    made = container.compress_contents(documents_from_tables(spark, d), _OPTIONS)
    return _stored_peaks(mzml.spectra_of(container.decompress_contents(made), _READ))


@query(f"select {_COLUMNS} from {_STORED} where {_LOOKED}")
def container_lookup(spark, d):
    """Random access by index: only the blocks with these spectra are decompressed."""
    return _stored_peaks(container.spectra_of(container.compress_contents(documents_from_tables(spark, d), _OPTIONS), LOOKUP))


@query(f"select file, cast(n as bigint) as index, scan, ms_level, cast(pos as bigint) as pos, mz, cast(intensity as double) as intensity from (select *, dense_rank() over (partition by file order by index) - 1 as n from {_STORED} where {_LOOKED})")
def subset_roundtrip(spark, d):
    """Documents of some spectra of each container, and what they hold."""
    made = container.compress_contents(documents_from_tables(spark, d), _OPTIONS)
    return _stored_peaks(mzml.spectra_of(container.extract_contents(made, LOOKUP), _READ))


@query(f"select file, cast(count(distinct scan) as bigint) as num_spectra, cast({columns.CONTAINER_MAGIC} as bigint) as magic_tag, true as whole, true as ordered from {_STORED} group by 1")
def container_footer(spark, d):
    """Footers of containers: their counts, and that sizes and sections are those of the documents."""
    documents = documents_from_tables(spark, d)
    rows = container.footers_of(container.compress_contents(documents, _OPTIONS))
    size = documents.select(F.col("path").alias("file"), big(F.octet_length("content")).alias("size"))
    ordered = (F.col("xml_pos") <= F.col("mz_binary_pos")) & (F.col("mz_binary_pos") <= F.col("inten_binary_pos")) & (F.col("inten_binary_pos") <= F.col("xml_blk_pos")) & (F.col("n_divisions") >= 2)
    return rows.join(size, "file").select(F.col("file").cast("bigint").alias("file"), "num_spectra", big(F.col("magic_tag")).alias("magic_tag"), (F.col("original_filesize") == F.col("size")).alias("whole"), ordered.alias("ordered"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
