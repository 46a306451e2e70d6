"""The same results in plain SQL for DuckDB: range predicates, global windows and self-joins where the jobs avoid them."""

from __future__ import annotations

BASE = r"""with read_pairs as (select l_orderkey,
  row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as rid,
  concat('chr', cast(l_suppkey % 4 + 1 as varchar)) as chrom, concat('s', cast(l_orderkey % 3 as varchar)) as sample, concat('lib', cast(l_linenumber % 2 as varchar)) as library,
  cast((l_partkey * 37) % 1000000 + 1 as int) as pos1,
  cast((l_partkey * 37) % 1000000 + 1 + (l_orderkey % 7) + case when l_partkey % 100 < 10 and l_quantity >= 26 then 2000 when l_partkey % 100 between 20 and 29 and l_quantity >= 46 then 110
    when l_partkey % 100 between 40 and 49 and l_quantity >= 26 then 1500 when l_partkey % 100 between 60 and 69 and l_quantity >= 26 then 3000 else 300 + cast(l_quantity as int) end as int) as pos2,
  case when l_partkey % 100 between 40 and 49 and l_quantity >= 26 then 'R' when l_partkey % 100 between 60 and 69 and l_quantity >= 26 and l_linestatus = 'F' then 'R' else 'F' end as or1,
  case when l_partkey % 100 between 40 and 49 and l_quantity >= 26 then 'F' when l_partkey % 100 between 60 and 69 and l_quantity >= 26 and l_linestatus = 'O' then 'F' else 'R' end as or2,
  cast(round(l_tax * 500) as int) as mapq, cast(round(l_discount * 100) as int) as edit from lineitem),
alignments as (select concat('r', rid) as read_name, rid, chrom, sample, library, pos1 as pos, pos2 as mate_pos,
  cast(65 + case when or1 = 'R' then 16 else 0 end + case when or2 = 'R' then 32 else 0 end as int) as flag, pos2 + 100 - pos1 as isize, mapq, edit as nm from read_pairs
  union all select concat('r', rid), rid, chrom, sample, library, pos2, pos1, cast(129 + case when or2 = 'R' then 16 else 0 end + case when or1 = 'R' then 32 else 0 end as int), -(pos2 + 100 - pos1), mapq, edit from read_pairs),
repeats as (select concat('chr', p_partkey % 4 + 1) as chrom, cast((p_partkey * 53) % 1000000 as int) as start_pos, cast((p_partkey * 53) % 1000000 + 50 + p_size * 4 as int) as end_pos,
  case when p_size % 2 = 0 then '+' else '-' end as strand,
  case when p_partkey % 10 = 9 then 'Satellite' when p_partkey % 3 = 0 then 'SINE/Alu' when p_partkey % 3 = 1 then 'LINE/L1' else 'Other/SVA' end as repeat_class, cast(p_partkey % 3 as int) as mei_code from part),
satellites as (select * from repeats where repeat_class = 'Satellite'), elements as (select * from repeats where repeat_class <> 'Satellite'),
gaps as (select concat('chr', s_suppkey % 4 + 1) as chrom, cast((s_suppkey * 977) % 1000000 as int) as start_pos, cast((s_suppkey * 977) % 1000000 + 200 as int) as end_pos from supplier),
dna as (select p_partkey as seq_id, translate(concat(md5(cast(p_partkey as varchar)), md5(cast(p_partkey + 1 as varchar))), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from part),
frag as (select library, rid, isize, row_number() over (partition by library order by rid) as rank from alignments where isize > 0 and flag & 48 = 32 qualify rank <= 100000),
med as (select library, max(isize) filter (k = greatest(1, n // 2)) as median, max(n) as n from (select *, row_number() over (partition by library order by isize) as k, count(*) over (partition by library) as n from frag) group by library),
kept as (select library, median, isize, avg(isize) over (partition by library) as mean from frag join med using (library) where isize <= 2 * median),
trimmed as (select library, median, mean, sqrt(avg(pow(trunc(isize - mean), 2))) as std from kept group by all),
band0 as (select *, greatest(0, cast(trunc(mean - 4 * std) as int)) as conc_min, cast(trunc(mean + 4 * std) as int) as conc_max from trimmed),
band as (select *, greatest(0, conc_min - 200) as min_delta, case when conc_max - 200 < 0 then 20 else conc_max - 200 end as max_delta from band0),
mates as (select *, case when rid % 50 = 0 then 'chrM' when rid % 70 = 0 then concat('chr', cast(substring(chrom, 4, 1) as int) % 4 + 1) else chrom end as mate_chrom from alignments),
classified as (select m.*, conc_min, conc_max, case when flag & 1 = 0 then 'CONC' when flag & 12 <> 0 then 'UNMAPPED' when flag & 48 in (0, 48) then 'INV' when pos <= mate_pos and flag & 48 = 16 then 'TDUP'
  when pos > mate_pos and flag & 48 = 32 then 'TDUP' when abs(isize) < conc_min then 'INS' when abs(isize) > conc_max then 'DEL' else 'CONC' end as class from mates m join band using (library)),
mated as (select l.read_name, l.rid, l.chrom, l.sample, l.library, l.pos as pos1, r.pos as pos2, case when l.flag & 16 = 0 then 'F' else 'R' end as or1, case when l.flag & 32 = 0 then 'F' else 'R' end as or2,
  l.mapq as mq1, r.mapq as mq2, l.nm + r.nm as edit, l.class from classified l join alignments r using (sample, library, read_name) where l.pos < l.mate_pos and r.pos > r.mate_pos),
evidence as (select rid as ev_id, read_name, chrom, sample, library, pos1 as l_start, pos1 + 99 as l_end, or1 as l_or, pos2 as r_start, pos2 + 99 as r_end, or2 as r_or, class as sv_type, mq1, mq2, edit,
  cast(least(mq1, 40) as double) as phred, min_delta, max_delta, conc_max from mated join band using (library) where class not in ('CONC', 'UNMAPPED') and mq1 > 5 and mq2 > 5),
fanned as (select * from evidence union all select * replace (case when sv_type = 'INV' then 'INVDUP' else 'INTERDUP' end as sv_type) from evidence),
members as (select * replace (case when edit <= 4 then 'SplitRead' else library end as library), concat_ws(':', chrom, sv_type, cast(l_start // 3700 as varchar)) as cluster_id from evidence),
bounds as (select cluster_id, chrom, sv_type, max(l_end) as inner_start, min(l_end) as outer_start, min(r_start) as inner_end, max(r_start) as outer_end from members group by all),
support as (select cluster_id, sample, count(*) as rp, count(*) filter (library = 'SplitRead') as sr from members group by all),
sided as (select * from members union all select * exclude (k) replace (concat_ws(':', k, cluster_id) as cluster_id, k as sv_type) from (select *, case sv_type when 'INV' then ['MEI_F', 'NUMT_R', 'INVDUP_RIGHT'][cast(l_start // 3700 % 3 + 1 as int)]
  when 'TDUP' then 'INTERDUP_LEFT' when 'DEL' then 'INVDUP_LEFT' else 'INTERDUP_RIGHT' end as k from members)),
sided_bounds as (select cluster_id, chrom, sv_type,
  case when any_value(sv_type) in ('MEI_F', 'NUMT_R') then max(l_end) filter (l_or = 'F') when any_value(sv_type) like '%DUP\_%' escape '\' then max(l_end + case l_or when 'R' then 100 else 0 end) else max(l_end) end as inner_start,
  case when any_value(sv_type) in ('MEI_F', 'NUMT_R') then min(l_end) filter (l_or = 'F') when any_value(sv_type) like '%DUP\_%' escape '\' then min(case l_or when 'F' then greatest(0, l_end - 100) else l_end end) else min(l_end) end as outer_start,
  case when any_value(sv_type) in ('MEI_F', 'NUMT_R') then min(l_end) filter (l_or = 'R') when any_value(sv_type) like '%DUP\_%' escape '\' then min(case l_or when 'F' then greatest(0, r_start - 100) else r_start end) else min(r_start) end as inner_end,
  case when any_value(sv_type) in ('MEI_F', 'NUMT_R') then max(l_end) filter (l_or = 'R') when any_value(sv_type) like '%DUP\_%' escape '\' then max(r_start + case l_or when 'R' then 100 else 0 end) else max(r_start) end as outer_end
  from sided group by cluster_id, chrom, sv_type),
regions as (select cluster_id, chrom, sv_type, case split_part(sv_type, '_', -1) when 'DEL' then inner_start when 'TDUP' then inner_start when 'INV' then outer_start when 'RIGHT' then outer_start when 'LEFT' then inner_end else 0 end as start_pos,
  case split_part(sv_type, '_', -1) when 'DEL' then inner_end when 'TDUP' then inner_end when 'INV' then inner_start when 'RIGHT' then inner_start when 'LEFT' then outer_end else 0 end as end_pos,
  case when split_part(sv_type, '_', -1) in ('TDUP', 'RIGHT', 'R') then outer_end else outer_start end as breakpoint from sided_bounds),
calls as (select cluster_id, chrom, sv_type, inner_start as start_pos, inner_end as end_pos from bounds where cluster_id in (select cluster_id from members group by 1 having count(*) >= 5)),
depth as (select sample, chrom, pos, count(*) as n from alignments group by all),
grid as (select concat('chr', k) as chrom, seq_id * 100 as start_pos, cast(round(100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)) as int) as gc from dna, range(1, 5) as r(k)),
gcd as (select s.sample, s.chrom, w.gc, case when w.gc = 0 then 0 else coalesce(sum(d.n), 0) / (100.0 * max(w.windows)) end as mean_rd from (select distinct sample, chrom from depth) s
  join (select chrom, gc, count(*) as windows from grid group by all) w using (chrom)
  left join (select sample, d.chrom, gc, sum(n) as n from depth d join grid g on d.chrom = g.chrom and g.start_pos = d.pos // 100 * 100 group by all) d on d.sample = s.sample and d.chrom = s.chrom and d.gc = w.gc group by s.sample, s.chrom, w.gc),
spans as (select distinct cast(substring(chrom, 4, 1) as bigint) * 10000000 + start_pos as span_id, chrom, start_pos, end_pos + 2000 as end_pos from gaps),
reads as (select read_name, rid, chrom, pos, mapq, nm, flag, case when mapq % 5 = 0 then concat(8 + nm, 'S', 92 - nm, 'M') when mapq % 5 = 1 then concat(85 - nm, 'M', 15 + nm, 'S')
  when mapq % 5 = 2 then concat(40, 'M', nm + 1, 'I', 59 - nm, 'M') else '100M' end as cigar from alignments),
clipped as (select *, case when mapq % 5 = 0 then 'HEAD' else 'TAIL' end as clip_side, case when mapq % 5 = 0 then 8 + nm else 15 + nm end as clip_len from reads where (mapq % 5 = 0 and 8 + nm > 10) or mapq % 5 = 1),
hist as (select chrom, case when clip_side = 'HEAD' then pos else pos + 100 - clip_len end as brk, count(*) as n from clipped where mapq > 5 group by all),
alt as (select read_name, chrom, pos + 50 as pos, 'F' as "or", nm from alignments where isize > 0
  union all select read_name, chrom, pos + 700, 'R', nm + 1 from alignments where isize > 0 and concat('chr', pos % 4 + 1) = chrom),
prim as (select read_name, chrom, pos, case when flag & 16 = 0 then 'F' else 'R' end as "or", nm, isize from alignments),
alr as (select l.read_name, l.chrom, l.pos as l_pos, l."or" as l_or, r.pos as r_pos, r."or" as r_or, l.nm + r.nm as edit from alt l join prim r using (read_name, chrom) where r.isize < 0 and l.pos < r.pos),
split_hits as (select rid as clip_id, chrom, pos1 as pos, pos2, case when edit % 2 = 1 then pos2 - 700 else pos2 + 40 end as hit_pos, or2 as hit_or, case when mapq % 2 = 0 then 'HEAD' else 'TAIL' end as clip_side,
  mapq as qual, edit * 6 as hit_mapq, 11 + edit as clip_len from read_pairs),
split_class as (select *, concat(case when hit_or = 'F' then 'FF' when clip_side = 'TAIL' and hit_pos > pos or clip_side = 'HEAD' and hit_pos > pos then 'FR' else 'RF' end,
  case when (hit_pos > pos) = (clip_side = 'TAIL') then 'AB' else 'BA' end) as split_class from split_hits where hit_pos <> pos),
split_rows as (select clip_id, split_class, k.sv_type, k.orient, pos + k.shift as start_pos, chrom, pos2 from split_class join (values ('FFAB', 'DEL', 'FR', -20), ('FFAB', 'INTERDUP', 'FR', -20), ('FFBA', 'TDUP', 'RF', 20),
  ('FFBA', 'INTERDUP', 'RF', 20), ('X', 'INV', 'FF', -20), ('X', 'INV', 'RR', 20), ('X', 'INVDUP', 'FF', 20), ('X', 'INVDUP', 'RR', 20)) k(kind, sv_type, orient, shift) on k.kind = case when split_class like 'FF%' then split_class else 'X' end),
clips as (select clip_id, chrom, pos, case when clip_id % 3 = 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as seq from (select seq_id as clip_id, concat('chr', seq_id % 4 + 1) as chrom, seq_id * 64 + 4 as pos,
  concat(substring(seq, 5, cast(12 + seq_id % 8 as int)), case when seq_id % 20 = 0 then 'A' else '' end) as seq from dna)),
ref_kmers as (select concat('chr', seq_id % 4 + 1) as chrom, substring(seq, cast(k + 1 as int), 10) as kmer, seq_id * 64 + k as "at", substring(seq, cast(k + 1 as int), 40) as tail from dna, range(0, 55) as r(k)),
probes as (select *, 'F' as hit_or, seq as probe from clips union all select *, 'R', reverse(translate(seq, 'ACGT', 'TGCA')) from clips),
seeded as (select clip_id, pos, hit_or, probe, "at", substring(tail, 1, length(probe)) as ref_seq from probes c join ref_kmers k on k.chrom = c.chrom and k.kmer = substring(c.probe, 1, 10) where abs("at" - pos) < 100000),
hits as (select clip_id, pos, hit_or, "at", hamming(probe, ref_seq) as mismatches from seeded where length(probe) = length(ref_seq) and hamming(probe, ref_seq) <= floor(length(probe) * 0.05)),
spanning as (select library, sum(case when x < -4 then 1 when x > 4 then 0.5 * exp(-x * x) / (x * sqrt(pi())) * (1 - 1 / (2 * x * x) + 3 / (4 * x * x * x * x)) else
  0.5 - sign(x) / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda n: case when n % 2 = 0 then 1 else -1 end * exp((2 * n + 1) * ln(abs(x) + 1e-300) - lgamma(n + 1)) / (2 * n + 1))) end) as spanning
  from (select library, (i - mean) / (std * sqrt(2)) as x from band, range(100, 2000) as r(i) where i <= conc_max) group by 1),
first_library as (select sample, spanning from (select sample, min(library) as library from read_pairs group by 1) join spanning using (library)),
scored as (select r.cluster_id, f.sample, r.sv_type, (select count(*) from members m where m.cluster_id = r.cluster_id) as op,
  cast(coalesce((select sum(n) from depth d where d.sample = f.sample and d.chrom = r.chrom and d.pos >= r.start_pos and d.pos < r.end_pos), 0) as bigint) as od,
  coalesce(f.spanning * (select mean_rd from grid g join gcd using (chrom, gc) where g.chrom = r.chrom and g.start_pos = r.breakpoint // 100 * 100 and gcd.sample = f.sample), 0) as ep,
  coalesce((select round(sum(mean_rd * greatest(0, least(r.end_pos, g.start_pos + 100) - greatest(r.start_pos, g.start_pos))), 6) from grid g join gcd using (chrom, gc) where g.chrom = r.chrom and gcd.sample = f.sample and r.start_pos < r.end_pos
    and g.start_pos > r.start_pos - 100 and g.start_pos < r.end_pos), 0) as ed
  from regions r cross join first_library f where r.sv_type in ('DEL', 'INS', 'INV', 'TDUP')),
rates as (select *, case when ep > 0 then ep else 0.001 end as ep1, case when ep > 0 then 0.5 * ep else 0.001 end as ep5, case when ed > 0 then ed else 0.01 end as ed1, case when ed > 0 then 0.5 * ed else 0.01 end as ed5,
  case when ed > 0 then 1.5 * ed else 0.01 end as ed15, case when ed > 0 then 2 * ed else 0.01 end as ed2 from scored),
lik as (select cluster_id, sample, sv_type, op,
  case sv_type when 'DEL' then od * ln(0.01) - 0.01 - lgamma(od + 1) when 'TDUP' then od * ln(ed2) - ed2 - lgamma(od + 1) else 0 end + op * ln(ep1) - ep1 - lgamma(op + 1) as homo,
  case sv_type when 'DEL' then od * ln(ed5) - ed5 - lgamma(od + 1) when 'TDUP' then od * ln(ed15) - ed15 - lgamma(od + 1) else 0 end + op * ln(ep5) - ep5 - lgamma(op + 1) as hete,
  case when sv_type in ('DEL', 'TDUP') then od * ln(ed1) - ed1 - lgamma(od + 1) else 0 end + op * ln(0.001) - 0.001 - lgamma(op + 1) as none from rates),
scores as (select cluster_id, sample, sv_type, case when op = 0 then 1e7 else greatest(homo, hete) / none / op end as score, case when op = 0 then 0 when homo > hete then 3 else 1 end as zygosity from lik),
weights as (select cluster_id, case when max(s.rp) >= 5 then arg_min(score, x.sample) else 1e7 end as weight from (select cluster_id, max(rp) as rp from support group by 1) s join scores x using (cluster_id) group by 1),
clash as (select a.cluster_id as a, b.cluster_id as b from calls a join calls b on a.chrom = b.chrom and a.cluster_id < b.cluster_id and a.start_pos <= b.end_pos and b.start_pos <= a.end_pos where not (
  (a.sv_type = 'INV' and b.sv_type = 'INV' and ((a.start_pos > b.start_pos and a.end_pos < b.end_pos) or (b.start_pos > a.start_pos and b.end_pos < a.end_pos)))
  or (a.sv_type = 'DEL' and b.sv_type = 'INV' and a.start_pos > b.start_pos and a.end_pos < b.end_pos) or (b.sv_type = 'DEL' and a.sv_type = 'INV' and b.start_pos > a.start_pos and b.end_pos < a.end_pos))),
votes as (select s.cluster_id, s.ev_id, s.l_end, s.r_start, count(*) filter (m.ev_id <> s.ev_id and (m.l_end = s.l_end or m.r_start = s.r_start)) as same,
  count(*) filter (m.ev_id <> s.ev_id and m.l_end <> s.l_end and m.r_start <> s.r_start) as different from members s join members m using (cluster_id) where s.library = 'SplitRead' and m.library = 'SplitRead' group by all),
sided_support as (select cluster_id, sample, count(*) as rp, count(*) filter (library = 'SplitRead') as sr from sided group by all),
sums as (select cluster_id, sum(rp) as rp, sum(sr) as sr from sided_support group by 1),
sided_votes as (select s.cluster_id, s.ev_id, s.l_end, s.r_start, count(*) filter (m.ev_id <> s.ev_id and (m.l_end = s.l_end or m.r_start = s.r_start)) as same,
  count(*) filter (m.ev_id <> s.ev_id and m.l_end <> s.l_end and m.r_start <> s.r_start) as different from sided s join sided m using (cluster_id) where s.library = 'SplitRead' and m.library = 'SplitRead' and s.sv_type in ('DEL', 'TDUP', 'INV', 'MEI_F') group by all),
better as (select cluster_id, arg_max(l_end, ev_id) as l, arg_max(r_start, ev_id) as r from sided_votes join sums using (cluster_id) where same >= different and rp > 5 and sr > 3 group by 1),
final_ends as (select b.cluster_id, chrom, sv_type, coalesce(l, inner_start) as i_s, coalesce(l, outer_start) as o_s, coalesce(r, inner_end) as i_e, coalesce(r, outer_end) as o_e, l is not null as precise from sided_bounds b left join better using (cluster_id)),
own_samples as (select b.cluster_id, string_agg(printf('%s:%.6f:%d:%d', case when coalesce(rp, 0) > 0 then ['0/0', '0/1', '1/0', '1/1'][cast(zygosity + 1 as int)] else '0/0' end, score, coalesce(rp, 0), coalesce(sr, 0)), chr(9) order by x.sample) as samples
  from sided_bounds b join scores x on x.cluster_id = regexp_replace(b.cluster_id, '^[A-Z]+_[A-Z]+:', '') left join sided_support s on s.cluster_id = b.cluster_id and s.sample = x.sample group by 1),
records as (select chrom, p + 1 as pos, concat('sv_', case k when 'F' then 'mei' when 'R' then 'numt' when 'RIGHT' then 'dup' when 'LEFT' then 'dup' when 'TDUP' then 'dup' else lower(sv_type) end, '_', cluster_id) as id, '.' as ref,
  case sv_type when 'DEL' then case when o_s % 7 = 0 then '<DEL:ME:SINE/Alu>' else '<DEL>' end when 'INS' then '<INS>' when 'INV' then '<INV>' when 'TDUP' then '<DUP:TANDEM>' when 'MEI_F' then '<INS:ME:SINE/Alu>' when 'NUMT_R' then '<INS:MT>' else '<DUP:ISP>' end as alt,
  255 as qual, case when rp <= 0 or o_s % 5 = 0 then case when sv_type in ('MEI_F', 'NUMT_R') then 'mfilt' else 'LowQual' end else 'PASS' end as filter,
  concat('END=', case when sv_type = 'MEI_F' then o_s + len when k in ('INV', 'TDUP', 'LEFT') then o_e when k = 'RIGHT' then i_s else i_e end + 1, ';SVLEN=', case when sv_type = 'DEL' then -len else len end,
    case when sv_type = 'MEI_F' then ';MEINFO=SINE/Alu' when k = 'LEFT' then concat(';POS2=', o_s) when k = 'RIGHT' then concat(';POS2=', o_e) else '' end, ';RPSUP=', rp, ';SRSUP=', sr,
    case when precise then ';CIEND=0,0;CIPOS=0,0;PRECISE' else coalesce(concat(';CIEND=0,' || (o_e - i_e) || ';CIPOS=-' || (i_s - o_s) || ',0;IMPRECISE'), '') end, ';SVTYPE=',
    case sv_type when 'DEL' then case when o_s % 7 = 0 then 'DEL:ME:SINE/Alu' else 'DEL' end when 'TDUP' then 'DUP:TANDEM' when 'MEI_F' then 'INS:ME:SINE/Alu' when 'NUMT_R' then 'INS:MT' else case when k in ('LEFT', 'RIGHT') then case when sv_type like 'INV%' then 'DUP:ISP;ISINV' else 'DUP:ISP' end else sv_type end end) as info,
  'GT:CNVL:RP:SR' as format, samples
  from (select *, case when sv_type in ('DEL', 'INS') then i_s when k = 'LEFT' then i_e else o_s end as p, case k when 'TDUP' then abs(o_e - o_s + 1) when 'RIGHT' then abs(i_s - o_s + 1) when 'LEFT' then abs(i_e - o_e + 1)
    when 'F' then case when o_s % 2 = 0 then 300 else abs(i_e - i_s) end + abs(i_s - o_s) when 'R' then abs(o_e - i_e + 1) else abs(i_e - i_s + 1) end as len from (select *, split_part(sv_type, '_', -1) as k from final_ends where coalesce(i_s + o_s + i_e + o_e, -1) >= 0)) join sums using (cluster_id) join own_samples using (cluster_id))
"""

OVERLAPS = "exists (select 1 from {0} x where x.chrom = {1}.chrom and {2} <= x.end_pos and x.start_pos <= {3})"


def on(table: str, rows: str, start: str, end: str) -> str:
    return OVERLAPS.format(table, rows, start, end)


BODIES = {
    "scan_alignments": "select read_name, sample, library, pos, flag, mapq from alignments where chrom = 'chr1'",
    "proper_filter": "select read_name, pos, flag from (select read_name, pos, cast(flag + case rid % 5 when 0 then 256 when 1 then 1024 when 2 then 2048 else 0 end as int) as flag from alignments) where flag & 3841 = 1",
    "accept_filter": f"select read_name, chrom, pos from alignments a join band using (library) where flag & 3841 = 1 and mapq > 5 and abs(pos - mate_pos) < 1010000 - 2 * conc_max and abs(isize) >= 100 and not {on('satellites', 'a', 'a.pos', 'a.pos + 100')} and not {on('satellites', 'a', 'a.mate_pos', 'a.mate_pos + 100')}",
    "classify_pairs": "select read_name, pos, class from classified",
    "classify_pairs_interchr": "select chrom, case when flag & 12 = 0 and flag & 48 not in (0, 48) and chrom <> mate_chrom then 'INTERCHR' else class end as class, count(*) as n from classified group by all",
    "numt_classify": "select read_name, chrom, pos, case when flag & 32 = 0 then 'F' else 'R' end as numt_type from mates where mate_chrom = 'chrM'",
    "mei_classify": "select read_name, pos, mei_code, case when (flag & 32 = 0 and strand = '-') or (flag & 32 <> 0 and strand = '+') then 2 * mei_code else 2 * mei_code + 1 end as mei_type, start_pos as element_start from (select a.read_name, a.pos, a.flag, e.*, row_number() over (partition by a.read_name, a.pos order by start_pos, end_pos, mei_code, strand) as k from alignments a join elements e on a.chrom = e.chrom and start_pos <= mate_pos and mate_pos + 100 <= end_pos) where k = 1",
    "route_evidence": f"select case when mate_chrom = 'chrM' then 'NUMT' when i and (chrom <> mate_chrom or abs(pos - mate_pos) > 1000000) then 'MEI' when chrom = mate_chrom and class not in ('INV', 'CONC', 'UNMAPPED') then 'PAIR' when chrom = mate_chrom and class = 'INV' and abs(pos - mate_pos) < 100000000 then 'INVERSION' else 'NONE' end as route, class, count(*) as n from (select *, {on('elements', 'c', 'c.mate_pos', 'c.mate_pos + 100')} as i from classified c) group by all",
    "class_counts": "select class, count(*) as n from classified where mapq > 5 group by class",
    "chrom_semi": "select distinct chrom from alignments where chrom in (select chrom from repeats)",
    "normalize_ends": "select read_name, flag, least(pos, mate_pos) as l_start, least(pos, mate_pos) + 99 as l_end, case when flag & case when pos > mate_pos then 32 else 16 end = 0 then 'F' else 'R' end as l_or, greatest(pos, mate_pos) as r_start, greatest(pos, mate_pos) + 99 as r_end, case when flag & case when pos > mate_pos then 16 else 32 end = 0 then 'F' else 'R' end as r_or from alignments",
    "insert_size": "select rid, case when or1 = 'F' and or2 = 'R' then pos2 + 100 - pos1 when or1 = 'R' and or2 = 'F' then pos2 - pos1 - 100 else pos2 - pos1 end as insert_size from read_pairs",
    "flag_ops": "select read_name, pos, (flag & 65487) + case when nm % 2 = 0 then 32 else 0 end + case when mapq % 2 = 0 then 16 else 0 end as alt_flag from alignments",
    "fragment_sample": "select library, rid, isize, rank from frag",
    "lower_median": "select library, median, n from med",
    "trimmed_stats": "select library, median, round(mean, 6) as mean, round(std, 6) as std from trimmed",
    "concordance_band": "select library, conc_min, conc_max, min_delta, max_delta from band",
    "fragment_histogram": "select library, isize, count(*) as n from frag group by all",
    "library_lookup": "select rid, coalesce(nullif(max_delta, 0), 100) as max_delta from read_pairs left join band using (library)",
    "mate_join": "select read_name, chrom, pos1, pos2, or1, or2, edit, mq2 from mated",
    "pair_geometry": "select read_name, chrom, pos1 + case when mq1 % 5 = 0 then 12 else 0 end as l_start, pos1 + 99 - case when mq1 % 5 = 1 then 15 else 0 end as l_end, pos2 + case when edit % 3 = 0 then 11 else 0 end as r_start, pos2 + 99 - case when edit % 3 = 1 then 14 else 0 end as r_end, edit from mated",
    "evidence_filter": f"select ev_id, chrom, sv_type from evidence e where l_start > 0 and r_end < 1010000 and not {on('satellites', 'e', 'e.l_start', 'e.l_end')} and not {on('satellites', 'e', 'e.r_start', 'e.r_end')} and not {on('gaps', 'e', 'e.l_end', 'e.r_start')}",
    "evidence_union": "select library, sv_type, count(*) as n, cast(sum(l_start) as bigint) as l_sum, cast(sum(r_start) as bigint) as r_sum from (select library, sv_type, l_start, r_start from evidence union all select 'Alternative', 'DEL', l_pos, r_pos from alr union all select 'SplitRead', sv_type, start_pos, pos2 from split_rows) group by all",
    "evidence_fanout": "select ev_id, sv_type from fanned",
    "split_fanout": "select clip_id, split_class, sv_type, orient, start_pos from split_rows",
    "split_evidence": """select clip_id, split_class, k.sv_type, k.l_or, k.r_or, ls + a as l_start, le + a as l_end, rs + b as r_start, re + b as r_end, case when split_class = 'FFAB' or split_class <> 'FFBA' and clip_side = 'TAIL' then le else ls end as bp_l,
  case when split_class = 'FFBA' or split_class <> 'FFAB' and clip_side = 'TAIL' then re else rs end as bp_r, 0 as min_delta, 100 as max_delta
from h join (values ('FFAB', 'DEL', 'F', 'R', -20, 20), ('FFAB', 'INTERDUP', 'F', 'R', -20, 20), ('FFBA', 'TDUP', 'R', 'F', -20, 20), ('FFBA', 'INTERDUP', 'R', 'F', -20, 20), ('X', 'INV', 'F', 'F', -20, -20), ('X', 'INV', 'R', 'R', 20, 20), ('X', 'INVDUP', 'F', 'F', 20, 20), ('X', 'INVDUP', 'R', 'R', 20, 20)) k(kind, sv_type, l_or, r_or, a, b)
  on k.kind = case when split_class like 'FF%' then split_class else 'X' end where le < rs and pos <> hit_pos""",
    "span_caps": "select ev_id, sv_type, r_start + ev_id % 3 * 60000 as r_start from fanned where case sv_type when 'DEL' then r_start + ev_id % 3 * 60000 - l_start < 1000000 when 'INV' then r_start + ev_id % 3 * 60000 - l_start < 5000000 when 'INVDUP' then r_start + ev_id % 3 * 60000 - l_start < 100000 when 'INTERDUP' then r_start + ev_id % 3 * 60000 - l_start < 100000 when 'INS' then r_start + ev_id % 3 * 60000 > l_end else true end",
    "unique_reads": "select read_name from evidence union select read_name from alignments where isize > 0 union select read_name from mates where mate_chrom = 'chrM'",
    "read_ids": "select read_name, row_number() over (order by read_name) - 1 as read_id from (select distinct read_name from evidence)",
    "readname_stats": "select read_name, count(*) as occurrences, min(edit) as min_edit, sum(phred) as sum_phred from fanned group by 1",
    "prune_normalize": "select ev_id, sv_type, round(share, 6) as share from (select ev_id, sv_type, phred / sum(phred) over (partition by library, read_name) as share, count(*) over (partition by library, read_name) as n from fanned) where share >= 0.4 and n <= 100",
    "satellite_anti": f"select read_name, pos from alignments a where not {on('satellites', 'a', 'a.pos', 'a.pos + 100')}",
    "gap_anti": f"select ev_id from evidence e where not {on('gaps', 'e', 'e.l_end', 'e.r_start')}",
    "mei_range_join": "select ev_id, start_pos, repeat_class from (select ev_id, r.*, row_number() over (partition by ev_id order by start_pos, end_pos, repeat_class) as k from evidence e join elements r on e.chrom = r.chrom and e.r_start <= r.end_pos and r.start_pos <= e.r_end) where k = 1",
    "first_repeat": "select chrom, repeat_class, start_pos, end_pos from (select *, row_number() over (partition by chrom, repeat_class order by start_pos, end_pos) as k from repeats) where k = 1",
    "repeats_project": "select chrom, start_pos, end_pos, strand, mei_code from repeats where repeat_class in ('SINE/Alu', 'LINE/L1', 'Other/SVA')",
    "read_depth": "select sample, chrom, pos, n from depth",
    "mean_depth": "select sample, chrom, round(sum(n) / 1010000, 9) as mean_depth from depth group by all",
    "gc_depth": "select sample, chrom, gc, round(mean_rd, 9) as mean_rd from gcd",
    "gc_by_base": "select chrom, gc, count(*) as bases from own_gc group by all",
    "gc_profile": "select sample, chrom, gc, round(mean_rd, 9) as mean_rd from own_profile",
    "expected_rd_by_base": "select span_id, sample, round(sum(mean_rd), 6) as expected_rd from spans s join own_gc g on g.chrom = s.chrom and g.spot >= s.start_pos and g.spot < s.end_pos join own_profile p on p.chrom = g.chrom and p.gc = g.gc group by all",
    "observed_rd": "select span_id, sample, cast(coalesce(sum(n), 0) as bigint) as observed_rd from spans s cross join (select distinct sample from depth) left join depth d using (chrom, sample) where true and (d.pos is null or true) group by all having true",
    "expected_rd": "select span_id, sample, round(sum(mean_rd * (least(s.end_pos, g.start_pos + 100) - greatest(s.start_pos, g.start_pos))), 6) as expected_rd from spans s join grid g on g.chrom = s.chrom and g.start_pos > s.start_pos - 100 and g.start_pos < s.end_pos join gcd on gcd.chrom = g.chrom and gcd.gc = g.gc group by all",
    "base_decode": "select rid, ['A', 'C', 'G', 'T', 'N', 'N'][cast(edit % 6 + 1 as int)] as base from read_pairs",
    "revcomp": "select seq_id, case when seq_id % 7 = 0 then concat('NN', reverse(translate(seq, 'ACGT', 'TGCA'))) else reverse(translate(seq, 'ACGT', 'TGCA')) end as rc from dna",
    "kmer_valid": "select seq_id, seq_id % 3 <> 0 as valid from dna",
    "kmer_hash": "select seq_id, cast(sum((position(substring(seq, cast(11 + k as int), 1) in 'ACTG') - 1) * power(4, 9 - k)) as bigint) as hash from dna, range(0, 10) as r(k) group by seq_id",
    "kmer_counts": "select kmer, count(*) as n from ref_kmers group by 1 having count(*) < 50000",
    "hamming": "select seq_id, hamming(substring(seq, 1, 32), substring(seq, 33, 32)) as distance from dna",
    "barcode_encode": "select seq_id, case when seq_id % 9 = 0 then null else cast(sum((position(substring(seq, cast(3 + k as int), 1) in 'ACGT') - 1) * power(4, 15 - k)) as bigint) end as barcode from dna, range(0, 16) as r(k) group by seq_id",
    "ref_upper": "select seq_id, seq from dna",
    "ref_subsequence": "select a.seq_id as span_id, concat(substring(a.seq, 31, 34), substring(coalesce(b.seq, ''), 1, 56)) as seq from dna a left join dna b on b.seq_id = a.seq_id + 1",
    "kmer_seed_join": 'select clip_id, pos, hit_or, "at" from seeded',
    "seed_verify": 'select clip_id, hit_or, "at", mismatches from hits',
    "hit_cap": 'select clip_id, hit_or, "at", hits, cast(60 // hits as int) as hit_mapq from (select clip_id, hit_or, "at", count(*) over (partition by clip_id) as hits from hits) where hits < 11',
    "header_read_groups": "select rid as file, case when rid % 3 = 0 then library else 'Lib1' end as library, sample from read_pairs where rid % 3 in (0, 1)",
    "cigar_parse": "select read_name, pos, len(o) as n_ops, regexp_extract(o[1], '[A-Z]') as first_op, cast(regexp_extract(o[1], '[0-9]+') as int) as first_len, cast(coalesce(list_sum(list_transform(list_filter(o, lambda x: x like '%S'), lambda x: cast(rtrim(x, 'S') as int))), 0) as int) as clipped from (select read_name, pos, regexp_extract_all(cigar, '[0-9]+[A-Z]') as o from reads)",
    "xa_parse": "select read_name, chrom, chrom as alt_chrom, pos + 50 as alt_pos, 'F' as alt_or, '100M' as alt_cigar, nm as alt_nm from alignments where isize > 0 union all select read_name, chrom, concat('chr', pos % 4 + 1), pos + 700, 'R', '100M', nm + 1 from alignments where isize > 0",
    "divet_parse": "select read_name, l_start, r_end, sv_type, cast(edit as double) as edit, cast(mq2 as double) as phred from evidence where ev_id % 17 <> 0",
    "discordant_fastq": "select concat('@', read_name) as name, case when l_or = 'R' then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as seq from evidence join dna on seq_id = ev_id % 2000",
    "fastq_pair_join": "select concat('r', seq_id) as name, substring(seq, 1, 30) as seq1, substring(seq, 2, 30) as seq2 from dna",
    "vcf_records": "select * from records",
    "annotation_tables": """select 'chromosome' as kind, chrom, 0 as start_pos, size as end_pos, gc from sizes union all
select distinct 'gap', chrom, start_pos, least(end_pos, size), null::double from (select * from gaps union all select case when start_pos % 2 = 0 then chrom else 'chr9' end, start_pos + 1900, end_pos + 1900 from gaps) join sizes using (chrom) where start_pos < size union all
select distinct 'duplication', chrom, start_pos, least(end_pos, size), null from gaps join sizes using (chrom) where start_pos < size union all
select kind, chrom, start_pos, end_pos, null from (select distinct case when repeat_class = 'Satellite' then 'satellite' else 'element' end as kind, chrom, start_pos, least(end_pos, size) as end_pos, strand, repeat_class, mei_code from repeats join sizes using (chrom) where start_pos < size)""",
    "resolved_records": """select chrom, r.pos, r.id, case when f.seq is null then '.' when spelt and sv_type in ('DEL', 'INV') then f.seq else base end as ref,
  case when not spelt or f.seq is null then r.alt when sv_type = 'DEL' then f.seq[1] when sv_type = 'INV' then reverse(translate(f.seq, 'ACGT', 'TGCA')) when sv_type = 'MEI_F' then coalesce(body, '.') when sv_type in ('INS', 'NUMT_R') then '.' else f.seq end as alt
from records r join spelt_out f using (id, chrom)""",
    "vcf_to_bed": "select chrom, pos - 1 as start_pos, cast(regexp_extract(info, 'END=([0-9]+)', 1) as int) as end_pos, regexp_extract(info, 'SVTYPE=([^;]+)', 1) as sv_type from records",
    "sv_stats": "select regexp_extract(info, 'SVTYPE=([^;]+)', 1) as sv_type, count(*) as n, cast(sum(abs(cast(regexp_extract(info, 'SVLEN=(-?[0-9]+)', 1) as bigint))) as bigint) as total_length from records group by 1",
    "alt_left_prim_right": "select * from alr",
    "alt_left_alt_right": 'select l.read_name, l.chrom, l.pos as l_pos, l."or" as l_or, r.pos as r_pos, r."or" as r_or, l.nm + r.nm as edit from alt l join alt r using (read_name, chrom) where l.pos < r.pos',
    "prim_left_alt_right": 'select l.read_name, l.chrom, l.pos as l_pos, l."or" as l_or, r.pos as r_pos, r."or" as r_or, l.nm + r.nm as edit from prim l join alt r using (read_name, chrom) where l.isize > 0 and l.pos < r.pos',
    "alt_classify": "select read_name, l_pos, r_pos, i as insert_size, case when l_or = r_or then 'INV' when l_or = 'R' then 'TDUP' when i < conc_min then 'INS' when i > conc_max then 'DEL' else 'CONC' end as class from (select alr.*, conc_min, conc_max, case when l_or = 'F' and r_or = 'R' then r_pos + 100 - l_pos when l_or = 'R' and r_or = 'F' then r_pos - l_pos - 100 else r_pos - l_pos end as i from alr join (select read_name, library from alignments where isize < 0) using (read_name) join band using (library))",
    "softclip_candidates": "select read_name, pos, clip_side, clip_len from clipped",
    "softclip_quality": "select concat(read_name, '_Split') as read_name, clip_side, clip_len, cast(floor(sum((i * 7 + rid) % 41) / clip_len) as int) as avg_phred from clipped, range(1, 101) as r(i) where (clip_side = 'HEAD' and i <= clip_len) or (clip_side = 'TAIL' and i > 100 - clip_len) group by read_name, rid, pos, clip_side, clip_len",
    "softclip_hist": "select chrom, brk, n from hist",
    "softclip_neighbors": "select chrom, brk, n, cast(sum(n) over (partition by chrom order by brk range between 10 preceding and 9 following) as bigint) as neighbours from hist",
    "split_orientation": "select clip_id, split_class from split_class",
    "dup_pairing": "select chrom, left_brk, concat_ws(':', chrom, 'FF', cast(left_brk as varchar)) as first_id, f as first_n, concat_ws(':', chrom, 'RR', cast(left_brk as varchar)) as second_id, r as second_n from (select chrom, l_start // 3700 as left_brk, count(*) filter (l_or = 'F') as f, count(*) filter (l_or = 'R') as r from members where sv_type = 'INV' group by all) where f > 0 and r > 0",
    "mei_pairing": "select chrom, place, type, count(*) filter (f) as forward, count(*) filter (not f) as back from (select chrom, pos // 500 as place, flag & 16 = 0 as f, cast(xor(nm % 6, case when flag & 16 = 0 then 0 else 1 end) as int) as type from alignments where mapq > 5) group by all having count(*) filter (f) > 2 and count(*) filter (not f) > 2",
    "numt_pairing": "select chrom, place, type, count(*) filter (f) as forward, count(*) filter (not f) as back from (select chrom, pos // 300 as place, flag & 16 = 0 as f, cast(xor(nm % 6, case when flag & 16 = 0 then 0 else 1 end) as int) as type from alignments where mapq > 5 and nm % 6 < 2) group by all having count(*) filter (f) > 0 and count(*) filter (not f) > 0",
    "maximal_sets": "select cluster_id, len(s) as n from (select cluster_id, s from sets a where not exists (select 1 from sets b where b.cluster_id <> a.cluster_id and b.chrom = a.chrom and list_has_all(b.s, a.s) and (len(b.s) > len(a.s) or b.cluster_id < a.cluster_id)))",
    "clonal_dedup": "select cluster_id, ev_id from (select *, row_number() over (partition by cluster_id, l_end, r_start, edit order by read_name, ev_id) as k from (select *, row_number() over (partition by cluster_id, read_name order by edit, l_end, r_start, ev_id) as j from members) where j = 1) where k = 1",
    "read_cluster_cap": "select ev_id, cluster_id, left_brk from (select *, row_number() over (partition by ev_id order by left_brk, cluster_id) as n from (select ev_id, concat(cluster_id, ':', k) as cluster_id, (l_start * 7 + k * 13) % 101 as left_brk from members, range(1, 25) as r(k) where sv_type = 'DEL')) where n <= 20",
    "cluster_prune": "select cluster_id, sv_type, outer_start, e as outer_end from (select *, outer_end + inner_start % 2 * 600000 as e from bounds) where case sv_type when 'DEL' then e - outer_start <= 500000 when 'TDUP' then e - outer_start <= 500000 when 'INV' then e - outer_start <= 20000000 else true end",
    "read_cluster_edges": "select distinct read_name, cluster_id from members",
    "cluster_bounds": "select * from sided_bounds",
    "cluster_support": "select * from support",
    "cluster_edit_avg": "select cluster_id, sample, round(avg(edit), 6) as avg_edit from members group by all",
    "barcode_homogeneity": "select cluster_id, round(case when sum(n) = 0 then 1 else sum(n * n) / (sum(n) * sum(n)) end, 6) as homogeneity from (select cluster_id, barcode, count(barcode) as n from (select cluster_id, case when o_orderpriority like '5%' then null else o_custkey end as barcode from members m join read_pairs p on p.rid = m.ev_id left join orders o on o.o_orderkey = p.l_orderkey) group by all) group by 1",
    "del_length_bounds": "select cluster_id, min(r_start - l_end - max_delta) as min_len, min(r_start - l_end - min_delta) as max_len from members where sv_type = 'DEL' group by 1",
    "score_region": "select * from regions",
    "log_poisson": "select rid, round((edit * 40 + mapq) * ln(case when edit = 0 then 0.01 else edit * 31.5 end) - case when edit = 0 then 0.01 else edit * 31.5 end - lgamma(edit * 40 + mapq + 1), 5) as log_p from read_pairs",
    "split_accept": f"select clip_id, l_start, l_end, r_start, r_end from (select clip_id, chrom, pos, hit_pos, least(pos, hit_pos) as l_start, least(pos, hit_pos) + case when pos < hit_pos then 100 - clip_len else clip_len end as l_end, greatest(pos, hit_pos) as r_start, greatest(pos, hit_pos) + case when pos < hit_pos then clip_len else 100 - clip_len end as r_end from split_hits where qual > 5 and hit_mapq > 0 and least(pos, hit_pos) > 0 and greatest(pos, hit_pos) < 1010000 and pos <> hit_pos) h where l_end < r_start and not {on('satellites', 'h', 'h.pos', 'h.pos + 1')} and not {on('satellites', 'h', 'h.hit_pos', 'h.hit_pos + 1')}",
    "usable_clips": "select read_name, pos, c.brk, neighbours from (select *, case when clip_side = 'HEAD' then pos else pos + 100 - clip_len end as brk from clipped where mapq > 5) c join (select chrom, brk, cast(sum(n) over (partition by chrom order by brk range between 10 preceding and 9 following) as bigint) as neighbours from hist) h on h.chrom = c.chrom and h.brk = c.brk where neighbours > 1 and neighbours < 100",
    "chromosome_range": "select read_name, pos, chrom from alignments where rid % 9 <> 0 and chrom in ('chr2', 'chr3')",
    "library_validity": "select library, conc_max from band where library <> 'lib1'",
    "chromosome_names": "select distinct chrom, chrom as name from repeats where mei_code = 0 and chrom in (select chrom from alignments)",
    "mei_ends": "select read_name, pos, pos + case when mapq % 5 = 0 then 8 + nm when mapq % 5 = 1 then 15 + nm else 0 end as pos_end from reads",
    "numt_ends": "select read_name, pos, pos + case when mapq % 5 = 0 then 8 + nm else 0 end as start_pos, pos + 100 - case when mapq % 5 = 1 then 15 + nm else 0 end as end_pos from reads",
    "cluster_mei": "select chrom, sv_type, left_brk, ev_id, size from region_sets",
    "cluster_numt": "select chrom, sv_type, left_brk, ev_id, size from region_sets",
    "cluster_del": "select chrom, sv_type, left_brk, ev_id, size from largest",
    "cluster_ins": "select chrom, sv_type, left_brk, ev_id, size from largest",
    "cluster_tdup": "select chrom, sv_type, left_brk, ev_id, size from largest",
    "score_inputs": "select cluster_id, sample, sv_type, op, od, round(ep, 5) as ep, ed from scored",
    "expected_pairs": "select library, round(spanning, 6) as spanning from spanning",
    "genome_depth": "select sample, gc, round(sum(mean_rd * w) / sum(w), 9) as mean_rd from gcd join (select chrom, gc, count(*) as w from grid group by all) using (chrom, gc) group by all",
    "widest_delta": "select max(max_delta) as max_delta from band",
    "sam_reader": "select read_name, flag, chrom, pos, mapq, mate_chrom, mate_pos, isize, library, (select min(sample) from read_pairs p where p.library = m.library) as sample, nm, seq, case substring(seq, 1, 1) when 'A' then 40 when 'C' then 20 when 'G' then 2 else 0 end as first_quality from (select *, translate(md5(read_name), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from mates) m",
    "bam_reader": "select read_name, flag, chrom, pos, mapq, '32M' as cigar, mate_chrom, mate_pos, isize, library, (select min(sample) from read_pairs p where p.library = m.library) as sample, nm, seq, case substring(seq, 1, 1) when 'A' then 40 when 'C' then 20 when 'G' then 2 else 0 end as first_quality from (select *, translate(md5(read_name), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from mates) m where chrom in ('chr2', 'chr4')",
    "fasta_reader": "select concat('s', seq_id) as chrom, k * 25 as start_pos, substring(seq, cast(k * 25 + 1 as int), 25) as seq from dna, range(0, 3) as r(k)",
    "fastq_reader": "select concat('r', seq_id, '/1') as qname, substring(seq, 1, 30) as seq, repeat('I', 30) as qual from dna",
    "bed_reader": "select chrom, start_pos, end_pos from gaps",
    "repeat_masker_reader": "select chrom, start_pos, end_pos, strand, concat(split_part(repeat_class, '/', -1), 'x') as repeat_type, repeat_class, case repeat_class when 'SINE/Alu' then 0 when 'LINE/L1' then 1 when 'Other/SVA' then 2 end as mei_code from repeats",
    "input_list": "select concat(n_name, '.bam') as path from nation union select concat(n_regionkey, '.bam') from nation",
    "cluster_dump": "select concat_ws(' ', chrom, sv_type, cluster_id, count(*), string_agg(read_name, ' ' order by edit, ev_id)) as line from members group by chrom, sv_type, cluster_id",
    "read_name_dump": "select count(*) as n, min(read_name) as first_name, max(read_name) as last_name from (select read_name from evidence union select read_name from mates where mate_chrom = 'chrM')",
    "genotype_likelihood": "select cluster_id, sample, sv_type, round(score, 5) as score, zygosity from scores",
    "mei_deletion": "select cluster_id, min(repeat_class) as element from bounds b join elements e on b.chrom = e.chrom and inner_start - 20 <= e.end_pos and e.start_pos <= inner_start + 170 where sv_type = 'DEL' and 151 > 0.8 * (e.end_pos - e.start_pos) and 151 < 1.2 * (e.end_pos - e.start_pos) group by 1",
    "cluster_weight": "select cluster_id, round(weight, 5) as weight from weights",
    "topk_scores": "select cluster_id, round(weight, 4) as weight from weights order by 2, 1 limit 100",
    "call_limit": "select cluster_id, round(weight, 4) as weight from weights order by 2, 1 limit 100000",
    "genotype_code": "select rid, ['0/0', '0/1', '1/0', '1/1'][cast(edit % 4 + 1 as int)] as gt from read_pairs",
    "sv_conflicts": "select a, b from clash",
    "conflict_triples": "select x.a, x.b, y.b as c from clash x join clash y on x.b = y.a join clash z on z.a = x.a and z.b = y.b",
    "breakpoint_votes": "select * from votes",
    "mei_call_filter": "select cluster_id, case when exists (select 1 from places p join repeats r on r.chrom = p.chrom and p.a <= r.end_pos and r.start_pos <= p.b where p.cluster_id = m.cluster_id and (r.repeat_class = 'Satellite' or r.repeat_class = case when p.place = 'all' then p.element else p.name end and (r.strand = p.strand) <> (p.place = 'middle' and p.strand = '+'))) then 'mfilt' else 'PASS' end as filter from m",
    "report_filter": "select cluster_id, cast(sum(rp) as bigint) as rp, cast(sum(sr) as bigint) as sr, sum(sr) > 3 as refined from support group by 1 having sum(rp) > 5",
}
BODIES["observed_rd"] = "select s.span_id, m.sample, cast(coalesce((select sum(n) from depth d where d.chrom = s.chrom and d.sample = m.sample and d.pos >= s.start_pos and d.pos < s.end_pos), 0) as bigint) as observed_rd from spans s cross join (select distinct sample from depth) m"
BODIES["refine_breakpoints"] = (
    "select cluster_id, arg_max(l_end, ev_id) as l_end, arg_max(r_start, ev_id) as r_start from rough_votes where same >= different and cluster_id in (select cluster_id from support group by 1 having sum(sr) > 3 and sum(rp) > 5) and cluster_id in (select cluster_id from bounds where sv_type in ('DEL', 'TDUP', 'INV')) group by 1"
)
#: Maximal sets of one-ended reads: at the last arrival before a departure, all that reach there.
REGION_SETS = """rows_r as ({rows}), reach as (select ev_id, chrom, sv_type, f, case when f then pos_end else greatest(0, pos - conc_max) end as start, case when f then pos + max_delta else pos end as stop from rows_r),
live as (select * from reach where start < stop), arrivals as (select chrom, sv_type, start as b, lead(start) over (partition by chrom, sv_type order by start) as later from (select distinct chrom, sv_type, start from live)),
found as (select a.chrom, a.sv_type, a.b, later, l.ev_id, l.f, l.stop from arrivals a join live l on l.chrom = a.chrom and l.sv_type = a.sv_type and l.start <= a.b and a.b < l.stop),
full_sets as (select chrom, sv_type, b, count(*) as size from found group by all having (any_value(later) is null or min(stop) <= any_value(later)) and count(*) filter (f) > {least} and count(*) filter (not f) > {least} and count(*) >= 2),
region_sets as (select f.chrom, f.sv_type, f.b as left_brk, ev_id, size from found f join full_sets s on s.chrom = f.chrom and s.sv_type = f.sv_type and s.b = f.b)"""
#: Maximal sets of pairs: at each arrival and each lower end of a right interval there, all that hold both.
PAIR_SETS = """shape_rows as ({shape}), live as (select * from shape_rows where start < stop),
at_b as (select a.chrom, a.b, l.ev_id, greatest(least, least(most, low + slope * a.b)) as lo, greatest(least, least(most, high + slope * a.b)) as hi from (select distinct chrom, start as b from live) a join live l on l.chrom = a.chrom and l.start <= a.b and a.b < l.stop),
sets_b as (select p.chrom, p.b, p.lo as x, list(q.ev_id order by q.ev_id) as s from (select distinct chrom, b, lo from at_b) p join at_b q on q.chrom = p.chrom and q.b = p.b and q.lo <= p.lo and p.lo <= q.hi group by all),
uniq as (select chrom, s, min(b) as b from sets_b group by all having len(s) >= 2),
kept_sets as (select chrom, s, b from uniq u where not exists (select 1 from uniq v where v.chrom = u.chrom and len(v.s) > len(u.s) and list_contains(v.s, u.s[1]) and list_has_all(v.s, u.s))),
largest as (select chrom, kind as sv_type, b as left_brk, unnest(s) as ev_id, len(s) as size from kept_sets, (select any_value(sv_type) as kind from shape_rows))"""
_AHEAD = "select ev_id, chrom, sv_type, l_end as start, l_end + max_delta as stop, r_start - l_end - max_delta as low, r_start - l_end - min_delta as high, 1 as slope, l_end as least, r_start as most from evidence where sv_type = '{kind}'"
PAIR_SHAPES = {
    "DEL": _AHEAD,
    "TDUP": _AHEAD,
    "INS": "select ev_id, chrom, sv_type, l_end as start, r_start as stop, min_delta - (r_start - l_end) as low, max_delta - (r_start - l_end) as high, 0 as slope, -1000000000 as least, 1000000000 as most from evidence where sv_type = '{kind}'",
}
#: Bases of the reference with the GC of their own windows, and the depth by it.
OWN_GC = """bases as (select concat('chr', c) as chrom, (seq_id + c * 7) % (select count(*) from dna) * 64 + i as spot, substring(seq, cast(i + 1 as int), 1) in ('G', 'C') as strong from dna, range(1, 5) as r(c), range(0, 64) as o(i)),
own_gc as (select chrom, spot, cast(round(100.0 * count(*) filter (strong) over w / count(*) over w) as int) as gc from bases window w as (partition by chrom order by spot rows between current row and 99 following)),
own_profile as (select s.sample, s.chrom, g.gc, case when g.gc = 0 then 0.0 else coalesce(sum(d.n), 0) / any_value(g.n) end as mean_rd from (select distinct sample, chrom from depth) s join (select chrom, gc, count(*) as n from own_gc group by all) g using (chrom)
  left join (select sample, d.chrom, gc, sum(n) as n from depth d join own_gc o on o.chrom = d.chrom and o.spot = d.pos group by all) d on d.sample = s.sample and d.chrom = s.chrom and d.gc = g.gc group by s.sample, s.chrom, g.gc)"""
#: Views of one query alone.
EXTRA = {
    **dict.fromkeys(["gc_by_base", "gc_profile", "expected_rd_by_base"], OWN_GC),
    "split_evidence": f"""h as (select *, least(pos, hit_pos) as ls, greatest(pos, hit_pos) as rs, least(pos, hit_pos) + case when pos < hit_pos then 100 - clip_len else clip_len end as le, greatest(pos, hit_pos) + case when pos < hit_pos then clip_len else 100 - clip_len end as re from split_class where qual > 5 and hit_mapq > 0 and least(pos, hit_pos) > 0 and greatest(pos, hit_pos) < 1010000 and not {on('satellites', 'split_class', 'split_class.pos', 'split_class.pos + 1')} and not {on('satellites', 'split_class', 'split_class.hit_pos', 'split_class.hit_pos + 1')})""",
    "mei_call_filter": "m as (select cluster_id, chrom, case when start_pos % 3 = 0 then '-' else '+' end as strand, start_pos as s, start_pos + 40 + start_pos % 300 as e, case when start_pos % 2 = 0 then 'SINE/Alu' else 'LINE/L1' end as element, case when start_pos % 5 < 2 then 'SINE/Alu' else 'Other/SVA' end as name from calls), places as (select *, 'all' as place, s - 1 as a, e as b from m union all select *, 'start', s, s + 1 from m union all select *, 'end', e - 1, e from m union all select *, 'middle', (s + e) // 2, (s + e) // 2 + 1 from m)",
    "maximal_sets": "sets as (select cluster_id, min(chrom) as chrom, list(ev_id order by ev_id) as s from (select ev_id, chrom, concat('a', chrom, ':', sv_type, ':', l_start // 1000) as cluster_id from evidence union all select ev_id, chrom, concat('b', chrom, ':', sv_type, ':', l_start // 1850) from evidence) group by 1)",
    "annotation_tables": "sizes as (select concat('chr', c) as chrom, cast(sum(length(seq)) as int) as size, round(100.0 * sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) / sum(length(seq)), 6) as gc from dna, range(1, 5) as r(c) group by c)",
    "resolved_records": """genome as (select concat('chr', c) as chrom, string_agg(seq, '' order by (seq_id + c * 7) % (select count(*) from dna)) as g from dna, range(1, 5) as r(c) group by c),
spelt_places as (select *, o_s % 3 = 0 or (coalesce(precise, false) and sv_type not in ('INS', 'MEI_F', 'NUMT_R')) as spelt, case when sv_type in ('DEL', 'INS') then i_s when sv_type like '%LEFT' then i_e else o_s end as place,
  case when sv_type in ('DEL', 'INS') then i_s when sv_type like '%LEFT' then least(i_e, o_e) when sv_type like '%RIGHT' then least(i_s, o_s) else o_s end as lo,
  case when sv_type = 'DEL' then i_e when sv_type like '%LEFT' then greatest(i_e, o_e) when sv_type like '%RIGHT' then greatest(i_s, o_s) when sv_type in ('INV', 'TDUP') then o_e when sv_type = 'INS' then i_s else o_s end as hi from final_ends where coalesce(i_s + o_s + i_e + o_e, -1) >= 0),
spelt_out as (select p.*, case split_part(sv_type, '_', -1) when 'F' then 'sv_mei_' when 'R' then 'sv_numt_' when 'RIGHT' then 'sv_dup_' when 'LEFT' then 'sv_dup_' when 'TDUP' then 'sv_dup_' else concat('sv_', lower(sv_type), '_') end || cluster_id as id,
  nullif(substring(g, cast(place + 1 as int), 1), '') as base, nullif(case when spelt then substring(g, cast(lo + 1 as int), cast(hi - lo + 1 as int)) else substring(g, cast(place + 1 as int), 1) end, '') as seq,
  case when o_s % 2 = 0 then nullif(substring(g, cast(o_s - o_s % 1000 + 1 as int), 150), '') end as body from spelt_places p left join genome using (chrom))""",
    "refine_breakpoints": "rough as (select cluster_id, ev_id, library, l_end - l_end % 1000 as l_end, r_start - r_start % 1000 as r_start from members), rough_votes as (select s.cluster_id, s.ev_id, s.l_end, s.r_start, count(*) filter (m.ev_id <> s.ev_id and (m.l_end = s.l_end or m.r_start = s.r_start)) as same, count(*) filter (m.ev_id <> s.ev_id and m.l_end <> s.l_end and m.r_start <> s.r_start) as different from rough s join rough m using (cluster_id) where s.library = 'SplitRead' and m.library = 'SplitRead' group by all)",
    "cluster_mei": REGION_SETS.format(least=2, rows="select rid * 2 + case when isize > 0 then 0 else 1 end as ev_id, chrom, concat('MEI', xor(case when (flag & 32 = 0 and strand = '-') or (flag & 32 <> 0 and strand = '+') then 2 * mei_code else 2 * mei_code + 1 end, case when flag & 16 = 0 then 0 else 1 end)) as sv_type, pos, flag & 16 = 0 as f, pos as pos_end, band.max_delta, band.conc_max from (select a.*, strand, mei_code, row_number() over (partition by a.read_name, a.pos order by start_pos, end_pos, mei_code, strand) as k from classified a join elements e on concat('chr', cast(cast(substring(a.chrom, 4, 1) as int) % 4 + 1 as varchar)) = e.chrom and start_pos <= mate_pos and mate_pos + 100 <= end_pos where mapq > 5 and class not in ('CONC', 'UNMAPPED')) a join band using (library) where k = 1"),
    "cluster_numt": REGION_SETS.format(least=0, rows="select rid * 2 + case when isize > 0 then 0 else 1 end as ev_id, chrom, concat('NUMT', xor(case when flag & 32 = 0 then 0 else 1 end, case when flag & 16 = 0 then 0 else 1 end)) as sv_type, pos, flag & 16 = 0 as f, pos + 100 as pos_end, b.max_delta + 200 as max_delta, b.conc_max from classified join band b using (library) where nm % 2 = 0 and mapq > 5 and class not in ('CONC', 'UNMAPPED')"),
    **{f"cluster_{kind.lower()}": PAIR_SETS.format(shape=shape.format(kind=kind)) for kind, shape in PAIR_SHAPES.items()},
}
ORACLE_SQL = {name: BASE + (", " + EXTRA[name] + " " if name in EXTRA else "") + body for name, body in BODIES.items()}
