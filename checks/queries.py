"""Registered queries: one callable per operator of the inventory, over the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from railflow.functions.vectors import vector_text
from railflow.operators import behaviour, features, flows, habits, predict, routes, spatial, trips
from railflow.plans import routes as route_plans
from railflow.plans import samples as plans
from railflow.skew import hot_keys

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MAX_K = 20
PREFIX = 5


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def over(name: str, view: Query, op: Callable[[DataFrame], DataFrame]) -> None:
    """Register ``op`` applied to one view."""
    QUERIES[name] = lambda spark, sf_dir: op(view(spark, sf_dir))


stored_trips, stored_ap = v.stored(v.trips), v.stored(v.ap)


def _whole(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.round(x * scale).cast("bigint"))


def _vec_text(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, vector_text(F.col(c)))
    return df


# ---- flows and behaviour
over("od_count", v.trips, flows.od_count)
over("od_hour_count", v.trips, flows.od_hour_count)
over("od_share", v.trips, flows.od_share)
over("od_hour_share", v.trips, flows.od_hour_share)
over("od_slot_share", v.trips, lambda t: flows.od_slot_share(t).withColumn("ratio", F.round("ratio", 9)))
over("od_date_share", v.trips, lambda t: flows.od_slot_share(t, "date").withColumn("ratio", F.round("ratio", 9)))
over("depart_vec", v.trips, lambda t: _vec_text(flows.depart_vec(t), "vec"))
over("arrive_vec", v.trips, lambda t: _vec_text(flows.arrive_vec(t), "vec"))
over("station_mobility", v.trips, flows.station_mobility)
over("station_vectors", v.trips, lambda t: _vec_text(flows.station_vectors(flows.station_mobility(t), v.N), "vec"))
over("od_avg_time", v.trips, flows.od_avg_time)
over("od_ordered", v.trips, flows.od_ordered)
over("origin_stats", v.trips, flows.origin_stats)
over("top_origin", v.trips, flows.top_origin)
over("trips_dist", v.trips, lambda t: behaviour.trips_dist(t).withColumn("share", F.round("share", 9)))
over("active_days_dist", v.trips, lambda t: behaviour.active_days_dist(t).withColumn("share", F.round("share", 9)))
over("active_dates_dist", v.trips, lambda t: behaviour.active_days_dist(t, "date").withColumn("share", F.round("share", 9)))
over("station_ranks", v.trips, behaviour.station_ranks)
over("rank_dist", v.trips, lambda t: behaviour.rank_dist(t).withColumn("share", F.round("share", 9)))

# ---- stations
over("nearest_station", v.sites, lambda s: spatial.nearest_station(s).withColumn("dist", F.round("dist", 4)))
over("mean_nearest", v.sites, lambda s: spatial.mean_nearest(s).withColumn("mean_dist", F.round("mean_dist", 4)))
over("gps_extent", v.sites, spatial.gps_extent)
over(
    "minmax_gps",
    v.sites,
    lambda s: spatial.minmax_gps(s)
    .withColumn("lon_norm", F.round("lon_norm", 9))
    .withColumn("lat_norm", F.round("lat_norm", 9)),
)


@query
def coded_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = v.named_trips(spark, sf_dir)
    return trips.code_stations(named, v.stations(spark, sf_dir)).select("event_id", "id", "os", "ds", "ot", "dt")


@query
def unknown_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.unknown_stations(v.named_trips(spark, sf_dir), v.stations(spark, sf_dir))


@query
def located_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = trips.locate(v.trips(spark, sf_dir), v.stations(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("o_lon", "o_lat", "d_lon", "d_lat")]
    return placed.select("event_id", "os", "ds", *rounded)


# ---- taps and trips
over("tap_pairs", v.taps, trips.pair_taps)


@query
def station_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = v.taps(spark, sf_dir).selectExpr(f"concat({v.NAMED.format('station')}, ' ') name")
    return trips.station_codes(named)


over("time_parts", v.trips, trips.time_parts)
over("clock_fields", v.trips, trips.clock_fields)
over("within_day", v.trips, trips.within_day)
over("active_travellers", v.trips, trips.active_travellers)
over("frequent_travellers", v.trips, lambda t: trips.frequent_travellers(t).select("event_id", "id"))
over("trip_index", v.trips, lambda t: trips.trip_index(t).select("event_id", "id", "idx"))
over("prediction_table", v.trips, trips.prediction_table)


@query
def sequence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plans.sequence_samples(v.trips(spark, sf_dir), v.stations(spark, sf_dir), PREFIX)
    steps = found.select(
        "id", "event_id", "day_of_week", "quarter", "k",
        F.col("d_lon").alias("last_d_lon"), F.col("d_lat").alias("last_d_lat"),
        F.posexplode("prefix").alias("pos", "p"),
    )
    gps = [F.round(f"p.{c}", 6).alias(c) for c in ("o_lon", "o_lat", "d_lon", "d_lat")]
    return steps.select(
        "id", "event_id", "pos", *gps, "p.mp", "p.ep", "p.normal", "p.weekend",
        "day_of_week", "quarter", F.round("last_d_lon", 6).alias("last_d_lon"),
        F.round("last_d_lat", 6).alias("last_d_lat"), "k",
    )


# ---- habits
@query
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = habits.profile_rows(habits.time_profiles(v.trips(spark, sf_dir)))
    return rows.select("id", "t", "w", F.round("density", 11).alias("density"))


@query
def denser_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.profile_rows(habits.time_profiles(v.trips(spark, sf_dir))).select("id", "t", "dist")


@query
def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = habits.habit_travellers(v.trips(spark, sf_dir))
    return found.select("id", F.explode("centres").alias("t"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored_trips(spark, sf_dir)
    return habits.label_trips(t, habits.habit_travellers(t), hot_keys(t, "id"))


@query
def trip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).filter("label is not null").select("event_id", "id", "label")


over("habit_pairs", stored_trips, lambda t: habits.habit_pairs(t).filter("dominant").select("id", "os", "ds", "cnt"))


@query
def habit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.habit_clusters(habits.cluster_counts(_labelled(spark, sf_dir)))


over("traveller_habits", stored_trips, lambda t: habits.habit_pairs(t).filter("habit").select("id", "os", "ds"))


@query
def last_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.last_irregular_samples(stored_trips(spark, sf_dir)).rows.select("id", "event_id", "os", "target", "idx")


@query
def all_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored_trips(spark, sf_dir)
    hot = hot_keys(t, "id")
    return habits.all_irregular(t, habits.habit_pairs(t, hot), hot).select("id", "event_id", "os", "ds")


def _feature(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plans.last_irregular_samples(stored_trips(spark, sf_dir)).personal(kind)

    QUERIES[f"feat_{kind}"] = run


for _kind in ("period", "origin", "visits"):
    _feature(_kind)


@query
def feat_group_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plans.last_irregular_samples(stored_trips(spark, sf_dir))
    return features.group_day_feature(s.rows, flows.od_share(s.trips))


@query
def feat_group_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plans.last_irregular_samples(stored_trips(spark, sf_dir))
    return features.group_hour_feature(s.rows, flows.od_hour_share(s.trips))


def _day_samples(spark: SparkSession, sf_dir: str) -> plans.SampleSet:
    return plans.last_irregular_samples(trips.within_day(stored_trips(spark, sf_dir)))


@query
def feat_td(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_samples(spark, sf_dir).personal("td_wd", "td_we")


@query
def feat_tsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_samples(spark, sf_dir).personal("tsd_wd", "tsd_we")


@query
def feat_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    crowd = features.crowd_table(flows.od_slot_share(stored_trips(spark, sf_dir)))
    return features.crowd_feature(_day_samples(spark, sf_dir).rows, crowd)


@query
def feat_crowd_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months apart: the days before the first of a month are the last of the month before."""
    crowd = features.crowd_table(flows.od_slot_share(stored_trips(spark, sf_dir), "date"))
    return features.crowd_feature(_day_samples(spark, sf_dir).rows, crowd, "date")


@query
def samples_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.samples_base(plans.last_irregular_samples(stored_trips(spark, sf_dir)))


@query
def samples_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plans.last_irregular_samples(stored_trips(spark, sf_dir))
    rows = plans.samples_base_dense(s, v.N)
    for kind in plans.BASE_KINDS:  # whole numbers print alike in both engines
        scale = 100_000 if kind.startswith("group") else 1
        rows = rows.withColumn(kind, vector_text(_whole(kind, scale)))
    return rows


over("samples_ext", stored_trips, plans.samples_ext)


@query
def samples_ext_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plans.samples_ext_dense(stored_trips(spark, sf_dir), v.N)
    for kind in plans.EXTENDED_KINDS:
        rows = rows.withColumn(kind, vector_text(_whole(kind, 100_000 if kind == "crowd" else 1)))
    return rows


@query
def multi_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plans.multi_samples(stored_trips(spark, sf_dir))
    return s.rows.join(features.traveller_number(s.drawn), "id").select(
        "id", "event_id", "os", "target", "idx", "traveller"
    )


@query
def legacy_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest irregular trips of travellers with a habit, the latest of the others."""
    return plans.multi_samples(stored_trips(spark, sf_dir), pick="legacy").drawn.select("id", "event_id", "os", "target")


over("samples_multi", stored_trips, lambda t: plans.samples_multi(plans.multi_samples(t)))


@query
def target_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.target_dist(plans.last_irregular_samples(stored_trips(spark, sf_dir)).rows)


# ---- baselines
def _markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.markov_ranks(plans.last_irregular_samples(stored_trips(spark, sf_dir)), v.N)


def _empirical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.empirical_ranks(plans.last_irregular_samples(stored_trips(spark, sf_dir)), v.N)


@query
def markov_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.tallies(_markov(spark, sf_dir), MAX_K)


@query
def empirical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.tallies(_empirical(spark, sf_dir), MAX_K)


@query
def accuracy_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.accuracy_curve(_empirical(spark, sf_dir), MAX_K)


@query
def markov_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of one k."""
    return predict.hit_tally(_markov(spark, sf_dir), 3)


@query
def top_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plans.last_irregular_samples(stored_trips(spark, sf_dir))
    return predict.top_stations(s.personal("visits"), 3).select("id", "event_id", "station", "rank")


# ---- routes
@query
def path_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routes.path_numbers(v.observed_paths(spark, sf_dir), ("os", "ds", "slot"))
    return found.select(
        "os", "ds", "slot", "path_no", F.array_join(F.col("st").cast("array<string>"), " ").alias("st"),
        F.round("cost", 6).alias("cost"),
    )


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.ap_segments(stored_ap(spark, sf_dir), v.od_interval(spark, sf_dir))


def _set_text(df: DataFrame) -> DataFrame:
    return df.withColumn("stations", F.array_join(F.col("stations").cast("array<string>"), ","))


@query
def ap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_text(_segments(spark, sf_dir)).select("ap_id", "os", "ds", "stations", "start", "n_rows")


@query
def high_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = routes.high_sampling(_segments(spark, sf_dir), routes.paths_by_od(v.paths(spark, sf_dir)))
    return _set_text(sampled).select("ap_id", "start", "os", "ds", "stations", "shortest")


@query
def subset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_od = routes.paths_by_od(v.paths(spark, sf_dir))
    found = routes.subset_match(routes.high_sampling(_segments(spark, sf_dir), by_od))
    return _set_text(found).select("ap_id", "start", "os", "ds", "stations", "path_no")


@query
def route_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_plans.route_ratio_job(stored_ap(spark, sf_dir), v.od_interval(spark, sf_dir), v.paths(spark, sf_dir))


over("matched_cards", v.idmap, routes.matched_cards)


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.trips(spark, sf_dir)
    return routes.card_trips(t, routes.matched_cards(v.idmap(spark, sf_dir)), hot_keys(t, "id"))


@query
def frequent_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.frequent_od(_own(spark, sf_dir))


@query
def busy_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.busy_od(_own(spark, sf_dir), v.transfer_stations(spark, sf_dir))


@query
def trip_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routes.trip_ap(_own(spark, sf_dir), v.ap(spark, sf_dir))
    return found.select("event_id", "ap_id", "ts", "station", "stay")


@query
def path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_od = routes.paths_by_od(v.paths(spark, sf_dir))
    ap = stored_ap(spark, sf_dir)
    matched = routes.path_match(routes.trip_traces(_own(spark, sf_dir), ap, by_od))
    return matched.select("event_id", "id", "os", "ds", "path_no", "transfers")


@query
def personal_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_plans.personal_routes_job(
        stored_trips(spark, sf_dir), stored_ap(spark, sf_dir), v.idmap(spark, sf_dir), v.paths(spark, sf_dir)
    ).withColumn("ratio", F.round("ratio", 9))


def _od_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_plans.od_matches(
        stored_trips(spark, sf_dir), stored_ap(spark, sf_dir), v.idmap(spark, sf_dir), v.paths(spark, sf_dir),
        v.transfer_stations(spark, sf_dir),
    )


@query
def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.path_features(_od_matches(spark, sf_dir), v.transfer_stations(spark, sf_dir))


@query
def path_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_plans.path_shares_job(
        stored_trips(spark, sf_dir), stored_ap(spark, sf_dir), v.idmap(spark, sf_dir), v.paths(spark, sf_dir),
        v.transfer_stations(spark, sf_dir),
    )


@query
def matched_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = v.paths(spark, sf_dir).filter("path_no = 2").select("os", "ds")  # ODs with a choice
    return route_plans.matched_traces_job(
        stored_trips(spark, sf_dir), stored_ap(spark, sf_dir), v.idmap(spark, sf_dir), v.paths(spark, sf_dir),
        v.transfer_stations(spark, sf_dir), chosen,
    )
