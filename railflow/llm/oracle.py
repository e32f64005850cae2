"""DuckDB SQL of the registered queries that SQL can express at the size of the correctness check."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op4_decontaminate"] = f"""
with item as (select coalesce(cast(item_id as varchar),'') item, {_WORDS} w from benchmark),
gram as (select distinct item, least(10,len(w)) k, array_to_string(w[i:i+least(10,len(w))-1],' ') g
  from item, unnest(range(1, len(w)-least(10,len(w))+2)) u(i) where len(w)>0),
doc as (select row_number() over () r, doc_id, {_WORDS} w from documents),
seen as (select d.r, i, s.k, array_to_string(w[i:i+s.k-1],' ') g from doc d, (select distinct k from gram) s, unnest(range(1, len(w)-s.k+2)) u(i)),
hit as (select s.r, s.i, s.k, g.item from seen s join gram g on g.k=s.k and g.g=s.g),
n as (select r, count(distinct p) n_hit from hit, unnest(range(i, i+k)) u(p) group by r),
named as (select r, list_sort(list(distinct item)) items from hit group by r)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n.n_hit,0) n_hit, cast(coalesce(len(items),0) as bigint) n_items,
sha256(coalesce(array_to_string(items,','),'')) items_sha256, coalesce(n.n_hit,0)>0 contaminated
from doc d left join n on n.r=d.r left join named on named.r=d.r"""

ORACLES["op2_ngram_join"] = f"""
with recursive doc as materialized (select row_number() over () r, doc_id, {_WORDS} w from documents),
gram as materialized (select distinct r, array_to_string(w[i:i+least(5,len(w))-1],' ') g
  from doc, unnest(range(1, len(w)-least(5,len(w))+2)) u(i) where len(w)>0),
size as materialized (select r, count(*) n from gram group by r),
pair as materialized (select a.r a, b.r b, count(*) c from gram a join gram b on a.g=b.g and a.r<>b.r group by a.r, b.r),
link as materialized (select a, b from pair join size x on x.r=a join size y on y.r=b where 5*c>=4*(x.n+y.n-c)),
reach as (select r, r as m from doc union select reach.r, link.b from reach join link on link.a=reach.m)
select d.doc_id, (select min(e.doc_id) from reach join doc e on e.r=reach.m where reach.r=d.r) class_id,
(select count(*) from link where a=d.r) n_links from doc d"""

ORACLES["op10_chat"] = """
with m as (select conv_id, turn + case when role='user' and conv_id%7=3 then 2 else 0 end as turn,
  case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end kind, role, text, length(text) n,
  case when role in ('user','assistant') then 'call_'||conv_id||'_'||(turn - case when role='assistant' then 1 else 0 end) end call_id from conversations),
id as (select conv_id, call_id, min(turn) filter (kind='call') call_turn, count(*) filter (kind='call') calls, count(*) filter (kind='result') results
  from m where call_id is not null group by conv_id, call_id),
x as (select m.*, i.call_turn, coalesce(i.calls,0) calls, coalesce(i.results,0) results,
  coalesce(kind='result' and i.call_turn>=m.turn, false) late from m left join id i on i.conv_id=m.conv_id and i.call_id=m.call_id)
select conv_id, row_number() over (partition by conv_id order by case when late then call_turn else turn end, late, turn, kind, call_id)-1 as position,
turn, kind, call_id,
case when kind='message' then 'plain' when kind='result' and calls=0 then 'orphan' when kind='call' and results=0 then 'unanswered'
  when calls>1 or results>1 then 'repeated' else 'linked' end status,
case when kind<>'call' then '' when n%4=0 then concat_ws(',', case when n%20 not between 1 and 15 then 'range:limit' end, case when n=0 then 'range:query' end)
  when n%4=1 then case when n>400 then 'range:key' else '' end when n%4=2 then case when n%8=2 then '' else 'missing:style' end else 'unknown_tool' end errors,
case kind when 'message' then '{"content":'||to_json(text)||',"role":'||to_json(role)||'}'
  when 'result' then '{"call_id":"'||call_id||'","content":'||to_json(text)||',"role":"tool"}'
  else '{"arguments":{'||case n%4 when 0 then '"limit":'||(n%20)||',"query":' when 1 then '"exact":true,"key":'
    when 2 then case when n%8=2 then '"style":"short",' else '' end||'"text":' else '"text":' end||to_json(text)||'},"call_id":"'||call_id||'","name":"'||
    case n%4 when 0 then 'search' when 1 then 'lookup' when 2 then 'summarize' else 'translate' end||'","role":"assistant"}' end message
from x"""

_LIMIT, _CONFIDENCE = 0.5, 0.95

ORACLES["op11_url_filters"] = f"""
with page as (select row_number() over () k, page_id, url, translate(regexp_extract(coalesce(url,''), '://([^/?#]*)', 1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url,''), '://[^/?#]*([^?#]*)', 1) path from pages),
rule as (select * from (values ('com','/','allow'),('example.com','/en/','block'),('www.example.com','/en/','allow'),('net','/es/','block'),('net','/fr/','block')) t(h,p,v)),
fit as (select k, max(struct_pack(n:=length(h||p), v:=v, r:=h||p)) b from page join rule on (host=h or ends_with(host,'.'||h)) and starts_with(path,p) group by k),
lab as (select doc_id, coalesce(min(quality),1)=0 or coalesce(max(toxic),0)=1 bad from labels where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
name as (select distinct host, regexp_replace(regexp_replace(host,'^.*@',''),':[0-9]*$','') nm from page),
place as (select host, case when regexp_matches(nm,'^[0-9.]+$') then nm else array_to_string(string_split(nm,'.')[-2:],'.') end dom,
  case when regexp_matches(nm,'^[0-9.]+$') then '' else string_split(nm,'.')[-1] end suf from name),
seen as (select host, count(*) n, sum(bad::int) bad from page join lab on doc_id=page_id where host<>'' group by host),
root as (select (coalesce(sum(bad),0)+0.5)/(coalesce(sum(n),0)+1) m, coalesce(sum(n),0) n from seen),
s0 as (select suf, sum(n) n, sum(bad) bad, any_value(m) m from seen join place using (host), (select m from root) group by suf),
ss as (select case when sum(n-1)>0 then sum(n*pow(bad/n-m,2)/(m*(1-m))-1)/sum(n-1) end o from s0),
sm as (select suf, (m*s+bad)/(s+n) m from s0, (select case when o is null then 1 when o>0 then least(greatest(1/o-1,1),1e3) else 1e3 end s from ss)),
d0 as (select dom, suf, sum(n) n, sum(bad) bad, any_value(m) m from seen join place using (host) join sm using (suf) group by dom, suf),
dd as (select case when sum(n-1)>0 then sum(n*pow(bad/n-m,2)/(m*(1-m))-1)/sum(n-1) end o from d0),
dm as (select dom, (m*s+bad)/(s+n) m from d0, (select case when o is null then 1 when o>0 then least(greatest(1/o-1,1),1e3) else 1e3 end s from dd)),
hh as (select case when sum(n-1)>0 then sum(n*pow(bad/n-m,2)/(m*(1-m))-1)/sum(n-1) end o from seen join place using (host) join dm using (dom)),
post as (select p.host, coalesce(dm.m,sm.m,root.m)*s+coalesce(bad,0) a, (1-coalesce(dm.m,sm.m,root.m))*s+coalesce(seen.n,0)-coalesce(bad,0) b, root.n total
  from place p left join seen on seen.host=p.host left join dm on dm.dom=p.dom left join sm on sm.suf=p.suf, root,
  (select case when o is null then 1 when o>0 then least(greatest(1/o-1,1),1e3) else 1e3 end s from hh)),
below as (select host, any_value(total) total, sum(exp(lgamma(a+b+i)-lgamma(a+1+i)-lgamma(b)+(a+i)*ln({_LIMIT})+b*ln(1-{_LIMIT}))) q
  from post, unnest(range(0,20000)) u(i) group by host)
select page_id, page.host, path, b.r as rule, coalesce(b.v, case when host<>'' and total>0 and 1-q>={_CONFIDENCE} then 'block' else 'allow' end) verdict
from page left join fit using (k) join below using (host)"""

ORACLES["op12_collocations"] = r"""
with piece as (select row_number() over () p, lang, regexp_extract_all(x, '[^\x20\x09]+') w from (select coalesce(lang,'und') lang,
  unnest(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) x from documents)),
gram as materialized (select lang, k, array_to_string(w[i:i+k-1],' ') g, count(*) f from piece, (select unnest([1,2,3,4]) k) s, unnest(range(1, len(w)-k+2)) u(i) group by lang, k, array_to_string(w[i:i+k-1],' ')),
total as (select lang, cast(sum(f) as bigint) n from gram where k=1 group by lang),
cand as materialized (select lang, k, g, f a, string_split(g,' ') w from gram where k>1 and f>=30),
split as (select lang, g, a, k, i, array_to_string(w[1:i],' ') lg, array_to_string(w[i+1:],' ') rg from cand, unnest(range(1,k)) u(i)),
side as materialized (select lang, g, f from gram where f>=30),
cut as (select s.lang, s.g, s.a, s.i, l.f l, r.f r, cast(2000000*s.a::hugeint // (l.f+r.f) as bigint) score
  from split s join side l on l.lang=s.lang and l.g=s.lg join side r on r.lang=s.lang and r.g=s.rg),
best as (select * from cut qualify row_number() over (partition by lang, g order by score, i)=1),
part as (select lang, array_to_string(w[i:i+m-1],' ') g, max(a) f from cand, (select unnest([2,3]) m) s, unnest(range(1,k-m+2)) u(i) where m<k group by all),
left_ as (select best.* from best left join part using (lang, g) where part.f is null or 100*part.f<80*a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(g)) rank from left_)
select lang, rank, g as phrase, a, l, r, n, score from ranked join total using (lang) where rank<=2000"""

ORACLES["op13_lexical_search"] = f"""
with doc as materialized (select row_number() over () d, doc_id, {_WORDS} w from documents),
size as (select d, doc_id, len(w) n from doc where len(w)>0),
corpus as (select count(*) nd, cast(sum(n) as bigint) nt from size),
tf as materialized (select d, t, count(*) tf from (select d, unnest(w) t from doc) group by d, t),
item as (select row_number() over () q, item_id, {_WORDS} w from benchmark),
ask as (select q, t, count(*) reps from (select q, unnest(w) t from item) group by q, t),
term as (select t, cast(floor(1000*ln((2*nd+2)::double/(2*count(*)+1))) as bigint) wt from tf, corpus where t in (select t from ask) group by t, nd),
score as (select q, d, cast(sum(reps*wt*((1000000000*tf)//(1000*tf+8*(25+(75*n*nd)//nt)))) as bigint) score
  from ask join term using (t) join tf using (t) join size using (d), corpus group by q, d),
ranked as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id) rank from score join size using (d) where score>0)
select item_id, cast(rank as int) rank, doc_id, score from ranked join item using (q) where rank<=10"""
