"""DuckDB SQL for the results of the registered queries, written from what they are to return and not from the operators."""

LINES = """
    with rows as (select doc_id, text, string_split(text, chr(10)) as l from documents),
    windows as (
      select doc_id, p, sha256(concat_ws(chr(10), l[p], l[p + 1], l[p + 2])) as w
      from (select doc_id, l, unnest(range(1, len(l) - 1)) as p from rows)),
    later as (
      select doc_id, p from (select doc_id, p, row_number() over (partition by w order by doc_id, p) as k from windows) where k > 1),
    gone as (select doc_id, list(distinct p + d) as g from later, (select unnest([0, 1, 2]) as d) group by doc_id),
    kept as (
      select r.doc_id, r.text, r.l, list_filter(range(1, len(r.l) + 1), lambda i: g is null or not list_contains(g, i)) as k
      from rows r left join gone using (doc_id))
    select doc_id, coalesce(len(l), 0)::bigint as n_lines, coalesce(len(l) - len(k), 0)::bigint as n_removed,
      case when text is not null then sha256(coalesce(array_to_string(list_transform(k, lambda i: l[i]), chr(10)), '')) end as kept_sha256
    from kept"""

#: Windows of ten words, or all words of a shorter item; a document's windows of every length that some item has are looked up.
DECONTAMINATION = r"""
    with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    s as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
    wanted as materialized (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as k from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as p from s)),
    sizes as (select distinct n from wanted),
    keys as (select distinct n, k from wanted),
    places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n),
    found as materialized (select doc_id, p, n, k from (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as k from places) semi join keys using (n, k)),
    hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from found) group by 1),
    items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from found join wanted using (n, k) group by 1)
    select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
      sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit using (doc_id) left join items using (doc_id)"""

#: Pairs that share a shingle are counted in full; components by walking the links.
NEAR_DUPLICATES = r"""
    with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    s as materialized (select distinct doc_id, md5(k) as k from (
      select doc_id, w[p] || ' ' || w[p + 1] as k from (select doc_id, w, unnest(range(1, len(w))) as p from d where len(w) >= 2)
      union all select doc_id, w[1] from d where len(w) = 1)),
    n as materialized (select doc_id, count(*) as n from s group by 1),
    pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
    links as materialized (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
    steps as materialized (select x, y from links union all select y, x from links),
    reach(x, y) as (select distinct x, x from steps union select r.x, t.y from reach r join steps t on t.x = r.y),
    part as (select x as doc_id, min(y) as component_id from reach group by 1)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
    from d left join n using (doc_id) left join part using (doc_id)"""

PASSAGES = r"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    places as (select doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as p from d where len(w) >= 13)),
    later as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by k) as low from places) where low < doc_id),
    gone as (select doc_id, list(distinct q) as g from (select doc_id, unnest(range(p, p + 13)) as q from later) group by 1),
    kept as (select d.doc_id, len(w) as n, coalesce(len(g), 0) as m, case when g is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(g, i)), lambda i: w[i]) end as k
      from d left join gone using (doc_id))
    select doc_id, n::bigint as n_words, m::bigint as n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept"""

#: Texts as hexadecimal digits, two a byte, cut into overlapping chunks, so no window is taken out of a long string.
BYTES = r"""
    with d as (select doc_id, hex(coalesce(text, '')) as h from documents),
    chunks as (select doc_id, c, substr(h, 2 * c + 1, 2 * 1199) as x, len(h) // 2 - 199 as last from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0), 1000)) as c from d)),
    places as (select doc_id, c + o as p, md5(substr(x, 2 * o + 1, 400)) as k from (select doc_id, c, x, unnest(range(0, least(1000, last - c))) as o from chunks)),
    again as (select doc_id, p from (select doc_id, p, count(*) over (partition by k) as n from places) where n > 1),
    marked as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 200 then 0 else 1 end as new from again),
    spans as (select doc_id, min(p) as a, max(p) + 200 as z from (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from marked) group by doc_id, run),
    gaps as (select doc_id, z as a, coalesce(lead(a) over (partition by doc_id order by a), 1000000000) as z from spans union all select doc_id, 0, min(a) from spans group by 1),
    kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' order by a) as k from gaps join d using (doc_id) group by 1),
    removed as (select doc_id, sum(z - a) as m, count(*) as n from spans group by 1)
    select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(m, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
    from d left join kept using (doc_id) left join removed using (doc_id)"""

#: Sums in the order of the components, so that doubles are the same to the last bit.
NEIGHBOURS = """
    with v as (select vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) as l
      from (select vec_id, embedding::double[] as e from embeddings)),
    s as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda x, y: x + y) / (q.l * c.l) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
    select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""

#: crc32 byte by byte from its table; near words by patterns with one place left open, and by one word being another less a place.
SPELLING = r"""
    with recursive crc as (select list(list_reduce(list_prepend(b::bigint, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t from range(256) x(b)),
    d as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as w from documents),
    r as materialized (select doc_id, w, count(*) as n from d group by 1, 2),
    b as (select doc_id, w, n, flatten(list_transform(string_split(doc_id::varchar || ':' || w, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [192 + (ord(c)::bigint >> 6), 128 + (ord(c)::bigint & 63)] end)) as y from r),
    h as (select w, n, xor(list_reduce(list_prepend(4294967295::bigint, y), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from b, crc),
    m as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from h),
    v as materialized (select word, sum(n)::bigint as n from m where length(word) >= 6 group by 1 having sum(n) >= 5),
    p as materialized (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as z from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
    less as (select distinct p.word as x, v.word as y from p join v on v.word = p.a || p.z),
    near as materialized (select x.word as x, y.word as y from p x join p y on x.i = y.i and x.a = y.a and x.z = y.z and x.word <> y.word union all select x, y from less union all select y, x from less),
    best as (select x as word, count(*) as n_near, first(y order by v.n desc, y) as form, max(v.n) as form_n from near join v on v.word = y group by 1),
    f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * v.n then form end as form, case when form_n >= 5 * v.n then form_n end as form_n from v left join best using (word)),
    walk(word, stop, form) as (select word, word, form from f union all select w.word, f.word, f.form from walk w join f on f.word = w.form)
    select f.word, f.form, w.stop as root, f.n, f.n_near, f.form_n from f join walk w on w.word = f.word and w.form is null"""

#: The sources that stop are those of the least size for their weight; a document's words are those of its streams' first target words.
MIXING = r"""
    with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
    s as (select source, sum(size)::bigint as source_size from d group by 1),
    w as materialized (select source, source_size, 2 * source_size as most, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from s),
    t as (select sum(source_size) * 1.5::double as total from s),
    o as (select *, coalesce(sum(most) over (order by most / weight, source rows between unbounded preceding and 1 preceding), 0) as held, sum(weight) over (order by most / weight, source rows between current row and unbounded following) as rest from w),
    stop as (select source from o, t where most < (total - held) / rest * weight),
    r as (select (select total from t) - coalesce(sum(case when source in (from stop) then most end), 0) as left_over, sum(case when source not in (from stop) then weight end) as rest from w),
    p as materialized (select source, source_size, case when source in (from stop) then most::double else left_over * weight / rest end as target from w, r),
    e as (select doc_id, size, p.*, epoch, ('0x' || left(md5('0:' || epoch || ':' || doc_id), 15))::bigint as place from d join p on d.source is not distinct from p.source, (select unnest([0, 1]) as epoch)),
    f as (select *, epoch * source_size + coalesce(sum(size) over (partition by source, epoch order by place, doc_id rows between unbounded preceding and 1 preceding), 0) as a from e),
    k as (select doc_id, greatest(0, least(a + size, floor(target)::bigint) - a)::bigint as n, size, source, source_size, target from f)
    select doc_id, size, source, source_size, target, sum(n)::bigint as taken from k group by doc_id, size, source, source_size, target"""
