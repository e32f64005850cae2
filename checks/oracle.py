"""DuckDB SQL that gives the same rows as each registered query.

Each entry of ``CTES`` is a named view; a query lists the views it reads and the WITH clause is
put together from their dependencies.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}

CTES["stations"] = """select n_nationkey station, n_name as name, 22.5::double + 0.02::double*(n_nationkey//5) + 0.001::double*((n_nationkey*3)%7) lat,
113.8::double + 0.02::double*(n_nationkey%5) + 0.001::double*((n_nationkey*7)%5) lon from nation"""
CTES["transfer_stations"] = "select n_nationkey station from nation where n_nationkey%6=0"
CTES["sites"] = """select cast(c_custkey as int) station, c_name as name, 22.4::double + 0.00001::double*((c_custkey*7919)%40000) lat,
113.7::double + 0.00001::double*((c_custkey*104729)%60000) lon from customer"""
CTES["taps"] = """select user_id id, event_id tap_id, date_trunc('second', ts) ts, cast(props->>'$.k' as int)%25 station,
case when event_type in ('purchase','error') then value else 0::double end fare from events"""
CTES["trips_e"] = """select event_id, user_id id, date_trunc('second', ts) ts, cast(props->>'$.k' as int) k, cast(event_id%10 as int) r from events"""
CTES["trips_h"] = """select *, cast(id%25 as int) home, cast((id*7+3)%25 as int) work, case cast(id%3 as int) when 0 then 8 when 1 then 4 else 0 end share from trips_e"""
CTES["trips_g"] = "select *, case when r<share and r%2=0 then 1 when r<share then 2 else 0 end dir from trips_h"
CTES["trips_o"] = """select event_id, id, case dir when 1 then home when 2 then work else k%25 end os,
case dir when 1 then work when 2 then home else (k+cast(event_id%23 as int)+1)%25 end ds,
case dir when 1 then date_trunc('day',ts)+to_seconds(8*3600+event_id%1200)
when 2 then date_trunc('day',ts)+to_seconds(18*3600+event_id%1200) else ts end ot from trips_g"""
CTES["trips"] = "select *, ot + to_seconds(300+120*(abs(os//5-ds//5)+abs(os%5-ds%5))+event_id%60) dt from trips_o"
CTES["named_trips"] = """select t.event_id, t.id, t.ot, t.dt, case when t.event_id%97=0 then 'UNKNOWN' else a.name end os_name, b.name ds_name
from trips t join stations a on a.station=t.os join stations b on b.station=t.ds"""
CTES["paths_p"] = """select a.n_nationkey os, b.n_nationkey ds, a.n_nationkey//5 r1, a.n_nationkey%5 c1, b.n_nationkey//5 r2, b.n_nationkey%5 c2
from nation a, nation b where a.n_nationkey<>b.n_nationkey"""
CTES["paths_q"] = """select *, case when c1<=c2 then range(c1,c2+1) else list_reverse(range(c2,c1+1)) end cs,
case when r1<=r2 then range(r1,r2+1) else list_reverse(range(r2,r1+1)) end rs from paths_p"""
CTES["paths"] = """select *, 2.0::double*(len(st)-1)+3.0::double*transfers as cost from (
select os, ds, 1 path_no, list_concat(list_transform(cs, lambda c: cast(r1*5+c as int)), list_transform(rs[2:], lambda r: cast(r*5+c2 as int))) st,
case when r1<>r2 and c1<>c2 then 1 else 0 end transfers from paths_q
union all
select os, ds, 2, list_concat(list_transform(rs, lambda r: cast(r*5+c1 as int)), list_transform(cs[2:], lambda c: cast(r2*5+c as int))), 1
from paths_q where r1<>r2 and c1<>c2)"""
CTES["od_interval"] = "select os, ds, cast(120*(len(st)-1) as bigint) sec from paths where path_no=1"
CTES["idmap"] = "select distinct user_id id, concat('ap', user_id) ap_id, (50+10*(user_id%6))/100::double score from events"
CTES["ap_n"] = "select os, ds, count(*) np from paths group by os, ds"
CTES["ap_j"] = """select t.event_id, t.id, t.ot, p.st from trips t join ap_n n on n.os=t.os and n.ds=t.ds
join paths p on p.os=t.os and p.ds=t.ds and p.path_no=1+case when n.np=2 then t.event_id%2 else 0 end"""
CTES["ap"] = """select concat('ap', id) ap_id, ot + to_seconds(60+120*(i-1)) ts, st[i] station, cast(event_id%4*10 as int) stay
from ap_j, unnest(range(1,len(st)+1)) u(i) where (event_id+i)%3<>0"""
CTES["observed_paths"] = """select o.os, o.ds, o.slot, p.st, p.transfers, o.sec/60::double + p.path_no as cost from
(select os, ds, cast(hour(ot) as int) slot, min(datediff('second', ot, dt)) sec from trips group by all) o
join paths p on p.os=o.os and p.ds=o.ds"""

PERIOD = "case when hour({0}) between 6 and 9 then 1 when hour({0}) between 11 and 13 then 2 when hour({0}) between 18 and 21 then 3 else 0 end"
SECOND = "cast(hour({0})*3600+minute({0})*60+second({0}) as int)"
WEEKDAY = "(dayofweek({0}) between 1 and 5)"
DAY = "case when day(ot)=day(dt) then day(ot) else 0 end"


def _habit_chain(trips: str, x: str) -> None:
    """Views of the habit chain over ``trips``; ``x`` ends their names."""
    CTES[f"act{x}"] = f"select id, count(*) n, count(distinct {DAY}) n_days from {trips} group by id having count(distinct {DAY})>5"
    CTES[f"pool{x}"] = f"""select id, t, count(*) w from (select id, {SECOND.format('ot')} t from {trips}
union all select id, {SECOND.format('dt')} from {trips}) where id in (select id from act{x}) group by id, t"""
    CTES[f"dens{x}"] = f"""select a.id, a.t, a.w, round(sum(b.w*exp(-pow(a.t-b.t,2)/(2*1800.0::double*1800)))/sqrt(2*pi())/(sum(b.w)*1800),15) d
from pool{x} a join pool{x} b on a.id=b.id group by a.id, a.t, a.w"""
    CTES[f"dist{x}"] = f"""select a.id, a.t, a.w, a.d, cast(coalesce(min(abs(a.t-b.t)), max(r.hi-r.lo)) as bigint) dist from dens{x} a
join (select id, min(t) lo, max(t) hi from dens{x} group by id) r on r.id=a.id
left join dens{x} b on b.id=a.id and b.d>a.d group by a.id, a.t, a.w, a.d"""
    CTES[f"means{x}"] = f"select id, sum(w) n, cast(sum(w*dist) as bigint)//cast(sum(w) as bigint) md, sum(w*d)/sum(w) mq from dist{x} group by id"
    CTES[f"spread{x}"] = f"select a.id, a.md, a.mq, sqrt(sum(b.w*(pow(b.dist-a.md,2)+pow(b.d-a.mq,2)))/sum(b.w)) sd from means{x} a join dist{x} b on a.id=b.id group by all"
    CTES[f"cen{x}"] = f"select b.id, b.t from spread{x} a join dist{x} b on a.id=b.id where a.sd>0 and sqrt(pow(b.dist-a.md,2)+pow(b.d-a.mq,2))/a.sd>=3"
    near = "arg_min(c.t, abs(c.t-{0})*100000::bigint+c.t) filter (abs(c.t-{0})<5400)"
    o, d = near.format(SECOND.format("x.ot")), near.format(SECOND.format("x.dt"))
    CTES[f"lab{x}"] = f"""select event_id, id, os, ds, case when o=d then o end as label from
(select x.event_id, x.id, x.os, x.ds, {o} o, {d} d from {trips} x join cen{x} c on c.id=x.id group by all)"""
    CTES[f"pc{x}"] = f"select id, os, ds, count(*) c from {trips} where id in (select id from cen{x}) group by all"
    CTES[f"dom{x}"] = f"""select a.id, a.os, a.ds, a.c from pc{x} a left join pc{x} b on b.id=a.id and b.os=a.ds and b.ds=a.os
join act{x} t on t.id=a.id where a.c+coalesce(b.c,0) > t.n//2"""
    CTES[f"clu{x}"] = f"""select l.id, l.label, l.os, l.ds, count(*) cnt from lab{x} l join act{x} a on a.id=l.id where l.label is not null
group by l.id, l.label, l.os, l.ds, a.n_days having count(*)>=5 or count(*)>a.n_days//2"""
    CTES[f"hab{x}"] = f"select id, os, ds from dom{x} union select id, os, ds from clu{x}"
    CTES[f"num{x}"] = f"select *, row_number() over (partition by id order by ot, event_id)-1 idx from {trips} where id in (select id from act{x})"
    CTES[f"odd{x}"] = f"select t.* from num{x} t where not exists (select 1 from hab{x} h where h.id=t.id and h.os=t.os and h.ds=t.ds)"
    CTES[f"smp{x}"] = f"select *, ds as target from odd{x} qualify row_number() over (partition by id order by idx desc)=1"
    CTES[f"last{x}"] = f"select * from smp{x} where idx>0"
    CTES[f"many{x}"] = f"select * exclude (k), ds as target from (select *, count(*) over (partition by id) k, row_number() over (partition by id order by idx desc) rn from odd{x}) where k>50 and rn<=20"
    CTES[f"multi{x}"] = f"select * from many{x} where idx>0"
    for s in ("last", "multi"):
        CTES[f"his_{s}{x}"] = f"""select s.id, s.event_id, h.os, h.ds, {PERIOD.format('h.ot')}={PERIOD.format('s.ot')} sp, h.os=s.os so, {WEEKDAY.format('h.ot')} wk
from {s}{x} s join num{x} h on h.id=s.id and h.idx<s.idx"""
        for kind, where in (
            ("period", "sp"), ("origin", "so"), ("td_wd", "sp and wk"), ("td_we", "sp and not wk"),
            ("tsd_wd", "sp and so and wk"), ("tsd_we", "sp and so and not wk"),
        ):
            CTES[f"f_{kind}_{s}{x}"] = f"""select id, event_id, '{kind}' feature, ds station, cast(count(*) as double) as value
from his_{s}{x} where {where} group by id, event_id, ds"""
        CTES[f"f_visits_{s}{x}"] = f"""select id, event_id, 'visits' feature, station, cast(count(*) as double) as value from
(select id, event_id, os station from his_{s}{x} union all select id, event_id, ds from his_{s}{x}) group by id, event_id, station"""
        CTES[f"f_day_{s}{x}"] = f"""select s.id, s.event_id, 'group_day' feature, g.ds station, g.ratio as value
from {s}{x} s join od_share g on g.os=s.os"""
        CTES[f"f_hour_{s}{x}"] = f"""select s.id, s.event_id, 'group_hour' feature, g.ds station, g.ratio as value
from {s}{x} s join od_hour_share g on g.os=s.os and g.hour=hour(s.ot)"""
        CTES[f"f_crowd_{s}{x}"] = f"""select s.id, s.event_id, 'crowd' feature, g.ds station, round(sum(g.ratio),5) as value
from {s}{x} s join od_slot_share g on g.os=s.os and g.slot=cast(hour(s.ot)//2 as int) and g.day between day(s.ot)-7 and day(s.ot)-1
group by s.id, s.event_id, g.ds"""
        CTES[f"base_{s}{x}"] = " union all ".join(f"select * from f_{k}_{s}{x}" for k in ("day", "hour", "period", "origin", "visits"))


CTES["od_share"] = "select os, ds, count(*) cnt, round(count(*)/sum(count(*)) over (partition by os), 5) ratio from trips group by os, ds"
CTES["od_hour_share"] = """select cast(hour(ot) as int) as hour, os, ds, count(*) cnt,
round(count(*)/sum(count(*)) over (partition by hour(ot), os), 5) ratio from trips group by hour(ot), os, ds"""
CTES["od_date_share"] = """select cast(cast(ot as date)-date '1970-01-01' as int) as day, cast(hour(ot)//2 as int) slot, os, ds, count(*) cnt,
count(*)/sum(count(*)) over (partition by cast(ot as date), hour(ot)//2, os) ratio from trips group by cast(ot as date), hour(ot)//2, os, ds"""
CTES["od_slot_share"] = """select cast(day(ot) as int) as day, cast(hour(ot)//2 as int) slot, os, ds, count(*) cnt,
count(*)/sum(count(*)) over (partition by day(ot), hour(ot)//2, os) ratio from trips group by day(ot), hour(ot)//2, os, ds"""
CTES["day_trips"] = "select * from trips where day(ot)=day(dt)"
_habit_chain("trips", "")
_habit_chain("day_trips", "_x")

CTES["mob"] = """select os station, 'to' side, ds partner, cast(hour(ot) as int) as hour, count(*) cnt from trips group by all
union all select ds, 'from', os, cast(hour(dt) as int), count(*) from trips group by all"""
CTES["mobility"] = "select * from mob where station in (select os from trips) and station in (select ds from trips)"

HEAD = """s.id, s.event_id, s.os, s.target, cast(hour(s.ot)//2 as int) st, s.idx"""
FLAGS = f"""cast({WEEKDAY.format('s.ot')} as int) weekday, cast(day(s.ot) in (7,8,9) as int) holiday"""

CTES["ap_prev"] = """select *, lag(station) over w p_station, lag(ts) over w p_ts, lag(stay) over w p_stay from ap
window w as (partition by ap_id order by ts, station, stay)"""
CTES["ap_break"] = """select a.*, case when p_ts is null then 0 when a.station=p_station then 1 when i.sec is null then 0
when abs(datediff('second',p_ts,ts)-p_stay) > i.sec + case when i.sec<1800 then 600 when i.sec<3600 then 1200 else 1800 end then 1
when i.sec>900 and abs(datediff('second',p_ts,ts)-p_stay) < 0.6*i.sec then 1 else 0 end brk
from ap_prev a left join od_interval i on i.os=a.p_station and i.ds=a.station"""
CTES["ap_seg"] = "select *, sum(brk) over (partition by ap_id order by ts, station, stay rows unbounded preceding) seg from ap_break"
CTES["segments"] = """select ap_id, arg_min(station, (ts, station, stay)) os, arg_max(station, (ts, station, stay)) ds, list_sort(list(distinct station)) stations,
min(ts) as start, count(*) n_rows from ap_seg group by ap_id, seg having count(*)>=2"""
CTES["sampled"] = """select s.*, p.shortest from segments s join (select os, ds, cast(min(len(st)) as int) shortest from paths group by all) p
on p.os=s.os and p.ds=s.ds where len(s.stations)-2 >= 0.5*(p.shortest-2)"""
CTES["subset"] = """select s.ap_id, s.start, s.os, s.ds, s.stations, min(p.path_no) path_no from sampled s join paths p on p.os=s.os and p.ds=s.ds
where list_has_all(p.st, s.stations) group by all having count(*)=1"""

CTES["cards"] = "select id, ap_id, score from idmap where score>0.7 qualify row_number() over (partition by id order by score desc, ap_id)=1"
CTES["own"] = "select t.*, c.ap_id from trips t join cards c on c.id=t.id"
CTES["freq"] = "select id, os, ds, count(*) cnt from own group by all having count(*)>3"
CTES["near_ap"] = """select o.event_id, o.id, o.os, o.ds, o.ot, o.dt, o.ap_id, a.ts, a.station, a.stay from own o join ap a on a.ap_id=o.ap_id
and a.ts > o.ot - interval 300 second and a.ts < o.dt + interval 300 second"""
CTES["traces"] = """select event_id, id, os, ds, ot, dt, list(station order by ts, station, stay) tr,
list(strftime(ts,'%Y-%m-%d %H:%M:%S')||','||station||','||stay order by ts, station, stay) recs from near_ap group by all"""
CTES["matched"] = """select t.*, p.path_no, p.transfers from traces t join paths p on p.os=t.os and p.ds=t.ds
where list_filter(p.st, lambda x: list_contains(t.tr, x)) = t.tr qualify count(*) over (partition by t.event_id)=1"""
CTES["od_matched"] = "select * from matched where os not in (select station from transfer_stations) and ds not in (select station from transfer_stations)"
CTES["stays"] = """select os, ds, path_no, sum(stay) stay from (select m.os, m.ds, m.path_no, n.station, sum(n.stay)//count(*) stay
from od_matched m join near_ap n on n.event_id=m.event_id join transfer_stations x on x.station=n.station group by all) group by all"""
CTES["pfeat"] = """select m.os, m.ds, m.path_no, cast(sum(datediff('second',ot,dt)) as bigint)//count(*) mean_sec, max(transfers) transfers,
cast(case when max(transfers)<>0 then coalesce(max(s.stay),0) else 0 end as bigint) transfer_stay, count(*) n_trips
from od_matched m left join stays s on s.os=m.os and s.ds=m.ds and s.path_no=m.path_no group by m.os, m.ds, m.path_no"""



def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it reads, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+([a-z_]+)", text):
            if name in CTES and name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    return "with " + ",\n".join(f"{n} as materialized ({CTES[n]})" for n in order) + "\n" + sql


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = with_views(sql)


def _hours(time: str) -> str:
    return "concat_ws(',', " + ", ".join(f"count(*) filter (hour({time})={h})" for h in range(24)) + ")"


oracle("od_count", "select os, ds, count(*) cnt from trips group by os, ds")
oracle("od_hour_count", "select cast(hour(ot) as int) as hour, os, ds, count(*) cnt from trips group by hour(ot), os, ds")
oracle("od_share", "select * from od_share")
oracle("od_hour_share", "select * from od_hour_share")
oracle("od_date_share", "select day, slot, os, ds, cnt, round(ratio, 9) ratio from od_date_share")
oracle("od_slot_share", "select day, slot, os, ds, cnt, round(ratio, 9) ratio from od_slot_share")
oracle("depart_vec", f"select os, ds, {_hours('ot')} vec from trips group by os, ds")
oracle("arrive_vec", f"select os, ds, {_hours('dt')} vec from trips group by os, ds")
oracle("station_mobility", "select * from mobility")
oracle("station_vectors", """select station, array_to_string(list(coalesce(c,0) order by pos),',') vec from
(select s.station, g.pos, max(m.cnt) c from (select distinct station from mobility) s cross join (select unnest(range(0,1200)) pos) g
left join mobility m on m.station=s.station and g.pos = case when m.side='to' then 0 else 600 end + m.partner*24 + m.hour group by all) group by station""")
oracle("od_avg_time", "select os, ds, cast(sum(datediff('second', ot, dt)) as bigint)//count(*) sec from trips group by os, ds")
oracle("od_ordered", "select os, ds, count(*) cnt from trips group by os, ds")
oracle("origin_stats", "select os, count(*) trips, count(distinct ds) destinations from trips group by os")
oracle("top_origin", "select os, count(*) trips, count(distinct ds) destinations from trips group by os order by 2 desc, 3 desc, 1 limit 1")
for _name, _col, _inner in (
    ("trips_dist", "n_trips", "select id, count(*) n_trips from trips group by id"),
    ("active_days_dist", "n_days", "select id, count(distinct day(ot)) n_days from trips group by id"),
    ("active_dates_dist", "n_days", "select id, count(distinct cast(ot as date)) n_days from trips group by id"),
):
    oracle(_name, f"select {_col}, count(*) cnt, round(count(*)/sum(count(*)) over (),9) share from ({_inner}) group by {_col}")
_RANKS = """select id, station, count(*) visits, cast(sum(a) as bigint) arrivals, cast(row_number() over (partition by id order by count(*) desc, station) as int) rank
from (select id, os station, 0 a from trips union all select id, ds, 1 from trips) group by id, station"""
oracle("station_ranks", _RANKS)
oracle("rank_dist", f"""select rank, cast(sum(arrivals) as bigint) cnt, round(sum(arrivals)/sum(sum(arrivals)) over (),9) share
from ({_RANKS}) where arrivals>0 group by rank""")
_NEAR = """select a.name as name, b.name as nearest, 2000*6378.137::double*asin(sqrt(pow(sin((radians(a.lat)-radians(b.lat))/2),2)
+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(a.lon)-radians(b.lon))/2),2))) dist
from sites a join sites b on a.name<>b.name qualify row_number() over (partition by a.name order by dist, b.name)=1"""
oracle("nearest_station", f"select name, nearest, round(dist,4) dist from ({_NEAR})")
oracle("mean_nearest", f"select round(avg(dist),4) mean_dist from ({_NEAR})")
oracle("gps_extent", "select min(lon) lon_min, max(lon) lon_max, min(lat) lat_min, max(lat) lat_max from sites")
oracle("minmax_gps", """select station, name, round((lon-min(lon) over ())/(max(lon) over ()-min(lon) over ()),9) lon_norm,
round((lat-min(lat) over ())/(max(lat) over ()-min(lat) over ()),9) lat_norm from sites""")
oracle("coded_trips", """select t.event_id, t.id, a.station os, b.station ds, t.ot, t.dt from named_trips t
join stations a on a.name=t.os_name join stations b on b.name=t.ds_name""")
oracle("unknown_stations", """select name, count(*) uses from (select os_name as name from named_trips union all select ds_name from named_trips)
where name not in (select name from stations) group by name""")
oracle("located_trips", """select t.event_id, t.os, t.ds, round(a.lon,6) o_lon, round(a.lat,6) o_lat, round(b.lon,6) d_lon, round(b.lat,6) d_lat
from trips t join stations a on a.station=t.os join stations b on b.station=t.ds""")
oracle("tap_pairs", """select id, ts ot, station os, fare o_fare, n_ts dt, n_station ds, n_fare d_fare from
(select *, lead(ts) over w n_ts, lead(station) over w n_station, lead(fare) over w n_fare from taps window w as (partition by id order by ts, tap_id))
where fare=0 and n_fare>0""")
oracle("station_codes", """select row_number() over (order by name)-1 station, name from
(select distinct 'S'||lpad(cast(station as varchar),2,'0') as name from taps)""")
oracle("time_parts", f"""select event_id, cast(day(ot) as int) as day, cast(hour(ot) as int) as hour, {PERIOD.format('ot')} period, {SECOND.format('ot')} as second,
cast(dayofweek(ot)+1 as int) weekday_no, cast(month(ot) as int) as month, cast(hour(ot)*4+minute(ot)//15 as int) as quarter,
cast((day(ot)-1)*48+hour(ot)*2+minute(ot)//30 as int) half_hour, cast(hour(ot)//2 as int) slot, cast({WEEKDAY.format('ot')} as int) weekday,
cast(day(ot) in (7,8,9) as int) holiday, cast(hour(ot) in (7,8,9) as int) morning_peak, cast(hour(ot) in (17,18,19) as int) evening_peak,
cast(hour(ot) not in (7,8,9,17,18,19) as int) normal_hour, cast({DAY} as int) trip_day from trips""")
oracle("clock_fields", """select event_id, strftime(ot,'%Y-%m-%d %H:%M:%S') as text, cast(epoch(ot) as bigint)-8*3600 as epoch,
strftime(ot,'%Y-%m-%d %H:%M:%S') back from trips""")
oracle("within_day", "select * from day_trips")
oracle("active_travellers", "select * from act")
oracle("frequent_travellers", "select event_id, id from trips qualify count(*) over (partition by id)>10")
oracle("trip_index", "select event_id, id, row_number() over (partition by id order by ot, event_id)-1 idx from trips")
oracle("prediction_table", """select id, ot, dt, os os_num, ds ds_num, cast(dayofweek(ot)+1 as int) day_of_week, cast(hour(ot)*4+minute(ot)//15 as int) as quarter,
cast(month(ot) as int) mon, cast(day(ot) in (7,8,9) as int) holiday from trips qualify count(*) over (partition by id)>10""")
oracle("sequence_samples", """select s.id, s.event_id, cast(h.idx-s.idx+5 as int) pos, round(ho.lon,6) o_lon, round(ho.lat,6) o_lat, round(hd.lon,6) d_lon, round(hd.lat,6) d_lat,
cast(hour(h.ot) in (7,8,9) as int) mp, cast(hour(h.ot) in (17,18,19) as int) ep, cast(hour(h.ot) not in (7,8,9,17,18,19) as int) normal,
cast(dayofweek(h.ot) in (0,6) as int) weekend, cast(dayofweek(s.ot)+1 as int) day_of_week, cast(hour(s.ot)*4+minute(s.ot)//15 as int) as quarter,
round(sd.lon,6) last_d_lon, round(sd.lat,6) last_d_lat, 5 k
from (select *, row_number() over (partition by id order by ot, event_id)-1 idx from trips) s
join (select *, row_number() over (partition by id order by ot, event_id)-1 idx from trips) h on h.id=s.id and h.idx between s.idx-5 and s.idx-1
join stations ho on ho.station=h.os join stations hd on hd.station=h.ds join stations sd on sd.station=s.ds
where s.idx>=5 and s.os=(select os from trips group by os order by count(*) desc, count(distinct ds) desc, os limit 1)""")
oracle("density", "select id, t, w, round(d,11) density from dens")
oracle("denser_distance", "select id, t, dist from dist")
oracle("centres", "select id, t from cen")
oracle("trip_labels", "select event_id, id, label from lab where label is not null")
oracle("habit_pairs", "select id, os, ds, c cnt from dom")
oracle("habit_clusters", "select * from clu")
oracle("traveller_habits", "select * from hab")
oracle("last_irregular", "select id, event_id, os, target, idx from last")
oracle("all_irregular", "select id, event_id, os, ds from odd")
for _k, _v in (("period", "period"), ("origin", "origin"), ("visits", "visits"), ("group_day", "day"), ("group_hour", "hour")):
    oracle(f"feat_{_k}", f"select * from f_{_v}_last")
oracle("feat_td", "select * from f_td_wd_last_x union all select * from f_td_we_last_x")
oracle("feat_tsd", "select * from f_tsd_wd_last_x union all select * from f_tsd_we_last_x")
oracle("feat_crowd", "select * from f_crowd_last_x")
oracle("feat_crowd_date", """select s.id, s.event_id, 'crowd' feature, g.ds station, round(sum(g.ratio),5) as value
from last_x s join od_date_share g on g.os=s.os and g.slot=cast(hour(s.ot)//2 as int) and date '1970-01-01'+g.day between cast(s.ot as date)-7 and cast(s.ot as date)-1
group by s.id, s.event_id, g.ds""")
oracle("samples_base", f"select {HEAD}, {FLAGS}, f.feature, f.station, f.value from last s join base_last f on f.event_id=s.event_id")


def _dense(kind: str, scale: int) -> str:
    hit = f"f.feature='{kind}'"
    return f"""array_to_string(list_transform(range(0,25), lambda i: cast(round({scale}*coalesce(map_from_entries(list((f.station, f.value)) filter ({hit}))[i],0)) as bigint)),',') {kind}"""


oracle("samples_dense", f"""select {HEAD}, {FLAGS}, {', '.join(_dense(k, 100000 if k.startswith('group') else 1) for k in ('group_day', 'group_hour', 'period', 'origin', 'visits'))}
from last s left join base_last f on f.event_id=s.event_id group by s.id, s.event_id, s.os, s.target, s.ot, s.idx""")
oracle("samples_ext", f"""select {HEAD}, f.feature, f.station, f.value from last_x s join (select * from f_crowd_last_x union all select * from f_td_wd_last_x
union all select * from f_td_we_last_x union all select * from f_origin_last_x union all select * from f_tsd_wd_last_x
union all select * from f_tsd_we_last_x union all select * from f_visits_last_x) f on f.event_id=s.event_id""")
oracle("samples_ext_dense", f"""select {HEAD}, {', '.join(_dense(k, 100000 if k == 'crowd' else 1) for k in ('crowd', 'td_wd', 'td_we', 'origin', 'tsd_wd', 'tsd_we', 'visits'))}
from last_x s left join (select * from f_crowd_last_x union all select * from f_td_wd_last_x
union all select * from f_td_we_last_x union all select * from f_origin_last_x union all select * from f_tsd_wd_last_x
union all select * from f_tsd_we_last_x union all select * from f_visits_last_x) f on f.event_id=s.event_id
group by s.id, s.event_id, s.os, s.target, s.ot, s.idx""")
_NUMBERED = "(select id, row_number() over (order by id)-1 traveller from (select distinct id from many))"
oracle("multi_samples", f"select s.id, s.event_id, s.os, s.target, s.idx, n.traveller from multi s join {_NUMBERED} n on n.id=s.id")
oracle("samples_multi", f"""select {HEAD}, {FLAGS}, f.feature, f.station, f.value, n.traveller from multi s join base_multi f on f.event_id=s.event_id
join {_NUMBERED} n on n.id=s.id""")
oracle("target_dist", "select os, target, count(*) cnt from last group by os, target")
CTES["grid"] = "select s.event_id, s.target, cast(g.n_nationkey as int) station from last s cross join nation g"
CTES["rank_e"] = """select event_id, target, station, row_number() over (partition by event_id order by v desc, station desc) rk from
(select g.event_id, g.target, g.station, coalesce(f.value,0) v from grid g left join f_visits_last f on f.event_id=g.event_id and f.station=g.station)"""
CTES["rank_m"] = """select event_id, target, station, row_number() over (partition by event_id order by v desc, station desc) rk from
(select g.event_id, g.target, g.station, coalesce(case when g.event_id in (select event_id from f_period_last) then p.value else d.value end,0) v from grid g
left join f_period_last p on p.event_id=g.event_id and p.station=g.station left join f_day_last d on d.event_id=g.event_id and d.station=g.station)"""
_TALLY = "select cast(k as int) k, count(*) filter (rk<=k) hits, count(*) total from {0} cross join (select unnest(range(1,21)) k) where station=target group by k"
oracle("markov_hits", _TALLY.format("rank_m"))
oracle("empirical_hits", _TALLY.format("rank_e"))
oracle("accuracy_curve", f"select *, round(hits/total,3) accuracy from ({_TALLY.format('rank_e')})")
oracle("top_visits", """select id, event_id, station, cast(row_number() over (partition by event_id order by value desc, station desc) as int) as rank from f_visits_last
qualify row_number() over (partition by event_id order by value desc, station desc)<=3""")
oracle("path_numbers", """select os, ds, slot, cast(row_number() over (partition by os, ds, slot order by cost, array_to_string(st,' ')) as int) path_no,
array_to_string(st,' ') st, round(cost,6) as cost from observed_paths""")
oracle("ap_segments", "select ap_id, os, ds, array_to_string(stations,',') stations, start, n_rows from segments")
oracle("high_sampling", "select ap_id, start, os, ds, array_to_string(stations,',') stations, shortest from sampled")
oracle("subset_match", "select ap_id, start, os, ds, array_to_string(stations,',') stations, path_no from subset")
oracle("route_ratio", """select p.os, p.ds, p.path_no, cast(len(p.st) as int) n_stations, p.transfers, p.cost,
concat(count(s.path_no),'/',sum(count(s.path_no)) over (partition by p.os,p.ds)) counts,
round(count(s.path_no)/nullif(sum(count(s.path_no)) over (partition by p.os,p.ds),0),3) ratio
from paths p left join subset s on s.os=p.os and s.ds=p.ds and s.path_no=p.path_no
where exists (select 1 from sampled x where x.os=p.os and x.ds=p.ds) group by p.os, p.ds, p.path_no, p.st, p.transfers, p.cost""")
oracle("matched_cards", "select * from cards")
oracle("frequent_od", "select * from freq")
oracle("busy_od", """select os, ds, count(*) cnt from own where os not in (select station from transfer_stations)
and ds not in (select station from transfer_stations) group by os, ds""")
oracle("trip_ap", "select event_id, ap_id, ts, station, stay from near_ap")
oracle("path_match", "select event_id, id, os, ds, path_no, transfers from matched")
oracle("personal_routes", """select m.id, m.os, m.ds, m.path_no, m.transfers, round(count(*)/sum(count(*)) over (partition by m.id,m.os,m.ds),9) ratio,
concat(count(*),'/',sum(count(*)) over (partition by m.id,m.os,m.ds)) counts
from matched m join freq f on f.id=m.id and f.os=m.os and f.ds=m.ds group by m.id, m.os, m.ds, m.path_no, m.transfers""")
oracle("path_features", "select * from pfeat")
oracle("path_shares", """select * exclude (k), round(n_trips/total,2) share from
(select *, cast(sum(n_trips) over (partition by os,ds) as bigint) total, count(*) over (partition by os,ds) k from pfeat) where k>1 and total >=
(select min(total) from (select sum(n_trips) total from pfeat group by os, ds having count(*)>1 order by 1 desc limit 100))""")
oracle("matched_traces", """select os, ds, path_no, id, event_id, datediff('second',ot,dt) sec, transfers, array_to_string(recs,';') records
from od_matched m where exists (select 1 from paths p where p.os=m.os and p.ds=m.ds and p.path_no=2)""")
oracle("markov_tally", "select cast(rk<=3 as int) flag, count(*) cnt, 3 k from rank_m where station=target group by 1")
oracle("legacy_samples", """select id, event_id, os, ds target from (select *, count(*) over (partition by id) k,
row_number() over (partition by id order by case when id in (select id from hab) then idx else -idx end) rn from odd) where k>50 and rn<=20""")
