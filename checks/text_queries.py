"""Registered queries of the readers and sinks: a view is written in a text layout and read back.

Every layout also holds lines that are malformed, repeated or of another kind, made from the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.oracle import _NUMBERED, CTES, FLAGS, ORACLES, _dense, oracle
from checks.queries import MAX_K, _empirical, _markov, _vec_text, _whole, query, stored_ap, stored_trips
from railflow.functions.vectors import vector_text
from railflow.operators import flows, predict
from railflow.operators.routes import path_numbers
from railflow.plans import routes as route_plans
from railflow.plans import samples as plans
from railflow.plans.samples import BASE_KINDS
from railflow.plans.trips import tap_trips
from railflow.sources import readers, sinks
from railflow.staging import stage, stage_dir


def _path(spark: SparkSession, label: str) -> str:
    return f"{stage_dir(spark)}/text-{label}-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, label: str, *parts: str | Column, sep: str = ",", wrap: bool = True) -> str:
    """Write one line per row from SQL expressions or columns; gives the folder."""
    body = F.concat_ws(sep, *[(F.expr(p) if isinstance(p, str) else p).cast("string") for p in parts])
    path = _path(rows.sparkSession, label)
    rows.select((F.concat(F.lit("("), body, F.lit(")")) if wrap else body).alias("value")).write.text(path)
    return path


def _time(column: str, bad: str = "false") -> str:
    return f"if({bad}, 'garbage', date_format({column}, 'yyyy-MM-dd HH:mm:ss'))"


def _station_lines(spark: SparkSession, sf_dir: str) -> str:
    return _lines(v.stations(spark, sf_dir), "stations", "station + 1", "name", "if(station % 10 = 3, 'n/a', string(lat))", "lon", "'x'", wrap=False)


@query
def read_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_stations(spark, _station_lines(spark, sf_dir))


oracle("read_stations", "select station, name, case when station%10=3 then null else lat end lat, lon from stations")


@query
def read_station_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_station_tuples(spark, _lines(v.stations(spark, sf_dir), "tuples", "station", "name"))


oracle("read_station_tuples", "select station, name, null::double lat, null::double lon from stations")

#: Twice every fiftieth line, a malformed time in some.
CTES["trip_lines"] = """select t.* from named_trips t union all select t.* from named_trips t where event_id%50=0"""


def _trip_lines(spark: SparkSession, sf_dir: str) -> str:
    named = v.named_trips(spark, sf_dir)
    twice = named.unionByName(named.filter("event_id % 50 = 0"))
    return _lines(twice, "trips", "id", _time("ot", "event_id % 89 = 1"), "os_name", "21", _time("dt"), "ds_name", "22")


@query
def read_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_trips(spark, _trip_lines(spark, sf_dir)).drop("event_id")


oracle("read_trips", """select cast(id as varchar) id, case when event_id%89=1 then null else date_trunc('second',ot) end ot, os_name,
date_trunc('second',dt) dt, ds_name from trip_lines""")


@query
def read_trip_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal lines are different trips."""
    rows = readers.read_trips(spark, _trip_lines(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))


oracle("read_trip_ids", "select count(*) n, count(*) n_ids from trip_lines")


@query
def read_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _lines(v.taps(spark, sf_dir), "taps", "id", _time("ts"), v.NAMED.format("station"), "'subway'", "fare")
    return readers.read_taps(spark, at).drop("tap_id")


oracle("read_taps", "select cast(id as varchar) id, ts, 'S'||lpad(cast(station as varchar),2,'0') station, fare from taps")


@query
def read_raw_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = f"if(tap_id % 3 = 0, 'bus', '{readers.SUBWAY}')"
    at = _lines(
        v.taps(spark, sf_dir), "raw", "id", "date_format(ts, 'yyyy-MM-dd')", "date_format(ts, 'HH:mm:ss')", v.NAMED.format("station"), mode, "fare",
        "'x'", wrap=False,
    )
    return readers.read_raw_taps(spark, at).drop("tap_id")


oracle("read_raw_taps", "select cast(id as varchar) id, ts, 'S'||lpad(cast(station as varchar),2,'0') station, fare from taps where tap_id%3<>0")


def _path_lines(spark: SparkSession, sf_dir: str) -> str:
    return _lines(v.paths(spark, sf_dir), "paths", "array_join(st, ' ')", "'#'", "transfers", "'V'", "cost", sep=" ", wrap=False)


@query
def read_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_paths(spark, _path_lines(spark, sf_dir)).withColumn("st", F.array_join("st", " "))


oracle("read_paths", "select os, ds, array_to_string(st,' ') st, cast(transfers as int) transfers, round(cost,2) as cost from paths")

CTES["od_names"] = """select a.name os_name, b.name ds_name, o.sec from od_interval o
join stations a on a.station=o.os join stations b on b.station=o.ds"""


def _interval_lines(spark: SparkSession, sf_dir: str) -> str:
    rows = v.od_interval(spark, sf_dir)
    for end in ("os", "ds"):
        rows = rows.join(v.stations(spark, sf_dir).select(F.col("station").alias(end), F.col("name").alias(f"{end}_name")), end)
    return _lines(rows, "intervals", "os_name", "ds_name", "sec")


@query
def read_od_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_od_interval(spark, _interval_lines(spark, sf_dir))


oracle("read_od_interval", "select * from od_names")


def _ap_lines(spark: SparkSession, sf_dir: str) -> str:
    """Records with the station's name; a stay of 0 is left out."""
    named = stored_ap(spark, sf_dir).join(v.stations(spark, sf_dir).select("station", "name"), "station")
    return _lines(named, "ap", "ap_id", _time("ts"), "name", F.expr("if(stay = 0, null, stay)"))


@query
def read_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_ap(spark, _ap_lines(spark, sf_dir))


oracle("read_ap", "select a.ap_id, date_trunc('second',a.ts) ts, s.name station_name, a.stay from ap a join stations s on s.station=a.station")


@query
def text_route_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text with station names to route shares."""
    known = v.stations(spark, sf_dir)
    ap = readers.name_to_code(readers.read_ap(spark, _ap_lines(spark, sf_dir)), known)
    interval = readers.read_od_interval(spark, _interval_lines(spark, sf_dir))
    for end in ("os", "ds"):
        interval = readers.name_to_code(interval, known, f"{end}_name", end)
    return route_plans.route_ratio_job(ap, interval, v.paths(spark, sf_dir))


oracle("text_route_ratio", ORACLES["route_ratio"][ORACLES["route_ratio"].index("select p.os, p.ds, p.path_no, cast(len") :])


@query
def read_idmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_idmap(spark, _lines(v.idmap(spark, sf_dir), "idmap", "id", "ap_id", "'x'", "score"))


oracle("read_idmap", "select cast(id as varchar) id, ap_id, score from idmap")


def _transfer_lines(spark: SparkSession, sf_dir: str) -> str:
    named = v.transfer_stations(spark, sf_dir).join(v.stations(spark, sf_dir), "station")
    return _lines(named.union(named), "transfers", "concat(name, ' ')", wrap=False)


@query
def read_transfer_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_transfer_stations(spark, _transfer_lines(spark, sf_dir))


oracle("read_transfer_stations", "select s.name from transfer_stations t join stations s on s.station=t.station")


@query
def read_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = F.expr(f"concat_ws('#', {', '.join(f'concat(os + {i}, \",\", ds)' for i in range(len(BASE_KINDS)))})".replace('"', "'"))
    at = _lines(v.trips(spark, sf_dir), "samples", "os", vectors, "ds", "hour(ot) div 2", "event_id", "1", "0", sep=":", wrap=False)
    return _vec_text(readers.read_samples(spark, at), *BASE_KINDS)


oracle("read_samples", f"""select os, {', '.join(f"(os+{i})||'.0,'||ds||'.0' {k}" for i, k in enumerate(BASE_KINDS))},
ds target, cast(hour(ot)//2 as int) st, cast(event_id as int) idx, 1 weekday, 0 holiday, null::int traveller from trips""")


def _tally_lines(ranks: DataFrame) -> str:
    """Tallies of every k, one ``(flag,cnt,k)`` line each."""
    flags = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(n).alias("cnt")) for f, n in ((1, "hits"), (0, "misses"))]))
    rows = predict.tallies(ranks, MAX_K).withColumn("misses", F.col("total") - F.col("hits")).select("k", flags.alias("t")).select("t.*", "k")
    path = _path(ranks.sparkSession, "tallies")
    sinks.write_text(rows.filter("cnt > 0").select("flag", "cnt", "k"), path)
    return path


_RANKED = "from {0} cross join (select unnest(range(1,21)) k) where station=target"


@query
def read_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_tallies(spark, _tally_lines(_empirical(spark, sf_dir)))


oracle("read_tallies", f"select cast(rk<=k as int) flag, count(*)::double cnt, cast(k as int) k {_RANKED.format('rank_e')} group by 1, 3")


@query
def merged_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tallies in text to the accuracy of every k, here of the Markov baseline."""
    return predict.merge_tallies(readers.read_tallies(spark, _tally_lines(_markov(spark, sf_dir))))


oracle("merged_accuracy", f"select cast(k as int) k, round(count(*) filter (rk<=k)/count(*),3) accuracy {_RANKED.format('rank_m')} group by k")


@query
def markov_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.accuracy_curve(_markov(spark, sf_dir), MAX_K)


oracle("markov_accuracy", f"""select cast(k as int) k, count(*) filter (rk<=k) hits, count(*) total,
round(count(*) filter (rk<=k)/count(*),3) accuracy {_RANKED.format('rank_m')} group by k""")


def _sample_lines(samples: DataFrame, tail: list[str]) -> str:
    path = _path(samples.sparkSession, "sample-lines")
    sinks.sample_text(samples, BASE_KINDS, tail).write.text(path)
    return path


TAIL = ["target", "st", "idx", "weekday", "holiday"]


def _text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plans.last_irregular_samples(stored_trips(spark, sf_dir))
    return readers.read_samples(spark, _sample_lines(plans.samples_base_dense(s, v.N), TAIL))


@query
def text_markov_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From sample text to the accuracy of every k."""
    return predict.accuracy_curve(plans.text_markov_ranks(_text_samples(spark, sf_dir)), MAX_K)


ORACLES["text_markov_accuracy"] = ORACLES["markov_accuracy"]


@query
def text_empirical_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.accuracy_curve(plans.text_empirical_ranks(_text_samples(spark, sf_dir)), MAX_K)


ORACLES["text_empirical_accuracy"] = ORACLES["accuracy_curve"]


@query
def text_top_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three stations of each sample line, zeros included."""
    rows = _text_samples(spark, sf_dir)
    return rows.select("os", "target", "idx", vector_text(predict.vector_top(F.col("visits"), 3)).alias("top"))


oracle("text_top_visits", """select l.os, l.target, cast(l.idx as int) idx, array_to_string(list(r.station order by r.rk),',') top from last l
join rank_e r on r.event_id=l.event_id where r.rk<=3 group by l.event_id, l.os, l.target, l.idx""")


@query
def text_multi_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several samples per traveller, as lines with the traveller number and read again."""
    s = plans.multi_samples(stored_trips(spark, sf_dir))
    rows = readers.read_samples(spark, _sample_lines(plans.samples_multi_dense(s, v.N), [*TAIL, "traveller"]))
    for kind in BASE_KINDS:
        rows = rows.withColumn(kind, vector_text(_whole(kind, 100_000 if kind.startswith("group") else 1)))
    return rows


_HEADER = "s.os, s.target, cast(hour(s.ot)//2 as int) st, cast(s.idx as int) idx"
oracle("text_multi_samples", f"""select {_HEADER}, {FLAGS}, {', '.join(_dense(k, 100000 if k.startswith('group') else 1) for k in BASE_KINDS)},
cast(any_value(n.traveller) as int) traveller from multi s left join base_multi f on f.event_id=s.event_id join {_NUMBERED} n on n.id=s.id
group by s.id, s.event_id, s.os, s.target, s.ot, s.idx""")


def _text_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trips written with station names, read again and coded."""
    known = readers.read_stations(spark, _station_lines(spark, sf_dir))
    named = v.trips(spark, sf_dir)
    for end in ("os", "ds"):
        named = named.join(v.stations(spark, sf_dir).select(F.col("station").alias(end), F.col("name").alias(f"{end}_name")), end)
    ordered = named.repartitionByRange("event_id").sortWithinPartitions("event_id")  # lines in the order of the trips
    lines = _lines(ordered, "all-trips", "id", _time("ot"), "os_name", "21", _time("dt"), "ds_name", "22")
    return stage(readers.code_names(readers.read_trips(spark, lines), known, {"os_name": "os", "ds_name": "ds"}).rows, "text-trips")


@query
def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From trips and stations in text to habits, last irregular trips, features and sample lines, read again."""
    s = plans.last_irregular_samples(_text_trips(spark, sf_dir))
    rows = readers.read_samples(spark, _sample_lines(plans.samples_base_dense(s, v.N), TAIL)).drop("traveller")
    for kind in BASE_KINDS:
        rows = rows.withColumn(kind, vector_text(_whole(kind, 100_000 if kind.startswith("group") else 1)))
    return rows


oracle("text_samples", f"""select {_HEADER}, {FLAGS}, {', '.join(_dense(k, 100000 if k.startswith('group') else 1) for k in BASE_KINDS)}
from last s left join base_last f on f.event_id=s.event_id group by s.id, s.event_id, s.os, s.target, s.ot, s.idx""")


@query
def text_personal_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal routes from text alone: trips, device records, the id map, stations and paths."""
    known = readers.read_stations(spark, _station_lines(spark, sf_dir))
    trips = _text_trips(spark, sf_dir)
    ap = stage(readers.code_names(readers.read_ap(spark, _ap_lines(spark, sf_dir)), known, {"station_name": "station"}).rows, "text-ap")
    idmap = readers.read_idmap(spark, _lines(v.idmap(spark, sf_dir), "idmap", "id", "ap_id", "'x'", "score"))
    paths = path_numbers(readers.read_paths(spark, _path_lines(spark, sf_dir)))
    found = route_plans.personal_routes_job(trips, ap, idmap, paths)
    return found.withColumn("id", F.col("id").cast("bigint")).withColumn("ratio", F.round("ratio", 9))


oracle("text_personal_routes", """select r.id, r.os, r.ds, p.no path_no, r.transfers, r.ratio, r.counts from
(select m.id, m.os, m.ds, m.path_no, m.transfers, round(count(*)/sum(count(*)) over (partition by m.id,m.os,m.ds),9) ratio,
concat(count(*),'/',sum(count(*)) over (partition by m.id,m.os,m.ds)) counts
from matched m join freq f on f.id=m.id and f.os=m.os and f.ds=m.ds group by m.id, m.os, m.ds, m.path_no, m.transfers) r
join (select os, ds, path_no, cast(row_number() over (partition by os, ds order by cost, array_to_string(st,' ')) as int) no from paths) p
on p.os=r.os and p.ds=r.ds and p.path_no=r.path_no""")


@query
def text_trip_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From taps and stations in text to coded trips and the destination shares of their origins."""
    at = _lines(v.taps(spark, sf_dir), "all-taps", "id", _time("ts"), v.NAMED.format("station"), "'subway'", "fare")
    names = _lines(v.taps(spark, sf_dir), "names", "station", v.NAMED.format("station"))
    paired = tap_trips(readers.read_taps(spark, at), readers.read_station_tuples(spark, names).distinct())
    return flows.od_share(paired)


CTES["tap_next"] = "select id, station os, lead(station) over w ds, fare, lead(fare) over w n_fare from taps window w as (partition by id order by ts, tap_id)"
oracle("text_trip_shares", """select os, ds, count(*) cnt, round(count(*)/sum(count(*)) over (partition by os),5) ratio from tap_next where fare=0 and n_fare>0 group by os, ds""")


@query
def dropped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names outside the dictionary in traces, intervals and transfer stations, each listed by the pass that drops them."""
    known = v.stations(spark, sf_dir).filter("station % 4 <> 1")
    inputs = {
        "ap": (readers.read_ap(spark, _ap_lines(spark, sf_dir)), {"station_name": "station"}),
        "interval": (readers.read_od_interval(spark, _interval_lines(spark, sf_dir)), {"os_name": "os", "ds_name": "ds"}),
        "transfer": (readers.read_transfer_stations(spark, _transfer_lines(spark, sf_dir)), {"name": "station"}),
    }
    out = None
    for kind, (rows, columns) in inputs.items():
        coded = readers.code_names(rows, known, columns)
        part = coded.dropped.select(F.lit(kind).alias("kind"), "name", "uses", F.lit(coded.counts["n_rows"]).cast("bigint").alias("n_rows"), F.lit(coded.counts["n_dropped"]).cast("bigint").alias("n_dropped"))
        out = part if out is None else out.union(part)
    return out


oracle("dropped_names", """select 'ap' kind, s.name, count(*) uses, (select count(*) from ap) n_rows, (select count(*) from ap where station%4=1) n_dropped
from ap a join stations s on s.station=a.station where s.station%4=1 group by s.name
union all select 'interval', s.name, count(*), (select count(*) from od_interval), (select count(*) from od_interval where os%4=1 or ds%4=1)
from (select os station from od_interval union all select ds from od_interval) o join stations s using (station) where s.station%4=1 group by s.name
union all select 'transfer', s.name, count(*), (select count(*) from transfer_stations), (select count(*) from transfer_stations where station%4=1)
from transfer_stations t join stations s using (station) where s.station%4=1 group by s.name""")


# ---- sinks, read back by Spark's own readers
@query
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _path(spark, "csv")
    sinks.write_csv(v.od_interval(spark, sf_dir), at)
    return spark.read.option("header", True).schema("os int, ds int, sec bigint").csv(at)


oracle("sink_csv", "select os, ds, sec from od_interval")


@query
def sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second result replaces the first."""
    at = _path(spark, "overwrite")
    sinks.write_table(v.trips(spark, sf_dir).select("event_id", "os", "ds"), at)
    sinks.write_table(v.trips(spark, sf_dir).filter("os > ds").select("event_id", "os", "ds"), at, mode="overwrite")
    return spark.read.parquet(at)


oracle("sink_overwrite", "select event_id, os, ds from trips where os>ds")


@query
def sink_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _path(spark, "slots")
    sinks.write_by_slot(stored_trips(spark, sf_dir).selectExpr("event_id", "os", "cast(hour(ot) div 2 as int) st"), at)
    return spark.read.parquet(at).select("event_id", "os", "st")


oracle("sink_by_slot", "select event_id, os, cast(hour(ot)//2 as int) st from trips")


@query
def sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _path(spark, "text")
    sinks.write_text(v.trips(spark, sf_dir).selectExpr("id", "ot", "if(os = 3, null, os) os"), at)
    return spark.read.text(at)


oracle("sink_text", "select '('||id||','||strftime(ot,'%Y-%m-%d %H:%M:%S')||','||coalesce(cast(nullif(os,3) as varchar),'null')||')' as value from trips")
