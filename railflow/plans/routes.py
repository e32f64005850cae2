"""Route choice jobs, from readers' tables to shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from railflow.operators import routes
from railflow.operators.habits import PAIR, hot_pairs
from railflow.skew import hot_keys, salted_join
from railflow.staging import stage


def route_ratio_job(ap: DataFrame, od_interval: DataFrame, paths: DataFrame) -> DataFrame:
    """Route shares of all ODs from anonymous device traces."""
    return routes.route_ratio(stage(routes.ap_segments(ap, od_interval), "segments"), paths)


def _matched(trips: DataFrame, ap: DataFrame, cards: DataFrame, paths: DataFrame) -> DataFrame:
    own = ap.join(cards.select("ap_id").distinct(), "ap_id", "left_semi")
    return routes.path_match(routes.trip_traces(trips, own, routes.paths_by_od(paths)))


def personal_matches(
    trips: DataFrame, ap: DataFrame, idmap: DataFrame, paths: DataFrame, min_trips: int = 3, min_score: float = 0.7
) -> DataFrame:
    """Uniquely matched trips of matched cards on ODs the traveller uses often."""
    hot = hot_keys(trips, "id")
    cards = stage(routes.matched_cards(idmap, min_score), "cards")
    own = routes.card_trips(trips, cards, hot)
    often = routes.frequent_od(own, min_trips).select("id", "os", "ds")
    kept = salted_join(own, often, PAIR, hot_pairs(trips, hot), "left_semi")
    return _matched(kept, ap, cards, paths)


def personal_routes_job(
    trips: DataFrame, ap: DataFrame, idmap: DataFrame, paths: DataFrame, min_trips: int = 3, min_score: float = 0.7
) -> DataFrame:
    return routes.personal_routes(personal_matches(trips, ap, idmap, paths, min_trips, min_score))


def od_matches(
    trips: DataFrame,
    ap: DataFrame,
    idmap: DataFrame,
    paths: DataFrame,
    transfer_stations: DataFrame,
    min_score: float = 0.7,
) -> DataFrame:
    """Uniquely matched trips of matched cards between non-transfer stations."""
    cards = stage(routes.matched_cards(idmap, min_score), "cards")
    own = routes.card_trips(trips, cards, hot_keys(trips, "id"))
    for end in ("os", "ds"):
        own = own.join(transfer_stations.withColumnRenamed("station", end).select(end), end, "left_anti")
    return _matched(own, ap, cards, paths)


def path_shares_job(
    trips: DataFrame,
    ap: DataFrame,
    idmap: DataFrame,
    paths: DataFrame,
    transfer_stations: DataFrame,
    kth: int = 100,
    min_score: float = 0.7,
) -> DataFrame:
    matched = stage(od_matches(trips, ap, idmap, paths, transfer_stations, min_score), "matched")
    features = stage(routes.path_features(matched, transfer_stations), "path_features")
    return routes.path_shares(features, kth)


def matched_traces_job(
    trips: DataFrame,
    ap: DataFrame,
    idmap: DataFrame,
    paths: DataFrame,
    transfer_stations: DataFrame,
    chosen: DataFrame,
    min_score: float = 0.7,
) -> DataFrame:
    """Matched trips of chosen ODs; the choice is applied before traces are put together."""
    kept = trips.join(chosen.select("os", "ds"), ["os", "ds"], "left_semi")
    matched = od_matches(kept, ap, idmap, paths, transfer_stations, min_score)
    return routes.matched_traces(matched, chosen)
