"""Driver queries of the content operators over the given tables, and the same in SQL.

The tables are no posts; orders, parts, documents, pages, conversations and labels stand in for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio import site_queries  # noqa: F401 (registers its queries)
from folio.config import Site
from folio.functions import dates, html, text, urls
from folio.functions.markdown import slugged
from folio.operators import archive, filters, listing, lookup, playlist, projections, search, taxonomy, toc
from folio.plans.storage import shared_dir, table
from folio.registry import _POSTS, oracle_sql, order_posts, queries  # noqa: F401
from folio.registry import query as _query
from folio.sources import parameters, sinks

@_query(_POSTS + "select slug from posts where draft is distinct from true")
def posts_prod_filter(spark, sf_dir):
    return filters.published_only(order_posts(spark, sf_dir)).select("slug")


@_query(_POSTS + """select slug, coalesce(lag(slug) over o, '') as next_slug, coalesce(lag(title) over o, '') as next_title,
  coalesce(lead(slug) over o, '') as prev_slug, coalesce(lead(title) over o, '') as prev_title
  from posts window o as (order by published desc, slug)""")
def posts_adjacent(spark, sf_dir):
    found = listing.adjacent(order_posts(spark, sf_dir).select("slug", "title", "published"))
    return found.select("slug", F.col("nextSlug").alias("next_slug"), F.col("nextTitle").alias("next_title"), F.col("prevSlug").alias("prev_slug"), F.col("prevTitle").alias("prev_title"))


@_query("select doc_id, lang, source, n_chars from documents")
def posts_list(spark, sf_dir):
    return projections.without_body(table(spark, sf_dir, "documents").withColumnRenamed("text", "body"))


@_query(_POSTS + """, n as (select slug, row_number() over (order by published desc, slug) as position, count(*) over () as total from posts),
  p as (select *, (position - 1) // 8 + 1 as page, cast(ceil(total / 8.0) as bigint) as last_page from n)
  select slug, position, cast(page as bigint) as page, last_page, cast((position - 1) % 8 * 50 as bigint) as delay_ms,
    case when page > 1 then case when page = 2 then '/' else '/' || cast(page - 1 as varchar) || '/' end end as prev_url,
    case when page < last_page then '/' || cast(page + 1 as varchar) || '/' end as next_url from p""")
def page_assign(spark, sf_dir):
    found = listing.paginated(order_posts(spark, sf_dir).select("slug", "published"))
    return found.select("slug", "position", "page", "last_page", F.col("delay_ms").cast("long").alias("delay_ms"), "prev_url", "next_url")


@_query(_POSTS + "select slug, published from posts order by published desc, slug limit 8 offset 16")
def page_third(spark, sf_dir):
    return listing.page_slice(order_posts(spark, sf_dir), 3).select("slug", F.col("published").cast("timestamp_ntz").alias("published"))


@_query("""with c as (select cast(ceil(count(*) / 8.0) as bigint) as last from orders), p as (select last, unnest(range(1, last + 1)) as cur from c),
  b as (select *, greatest(1, least(cur - 2, last - 4)) as l, least(last, greatest(cur + 2, 5)) as r from p)
  select cur, last, array_to_string(list_concat(case when l > 1 then [1] else [] end, case when l = 3 then [2] when l > 3 then [-1] else [] end, range(l, r + 1),
    case when r < last - 2 then [-1] when r = last - 2 then [last - 1] else [] end, case when r < last then [last] else [] end), ',') as strip from b""")
def page_strip(spark, sf_dir):
    """The strip below each page of the list of orders."""
    pages = listing.paginated(order_posts(spark, sf_dir).select("slug", "published")).select(F.col("page").alias("cur"), F.col("last_page").alias("last")).distinct()
    return pages.select("cur", "last", F.array_join(listing.page_strip(F.col("cur"), F.col("last")).cast("array<string>"), ",").alias("strip"))


@_query("""select name, count(*) as count, '/archive/?tag=' || replace(url_encode(name), '+', '%20') as url
  from (select unnest(string_split(p_name, ' ')) as name from part) group by name""")
def tag_counts(spark, sf_dir):
    return taxonomy.tag_counts(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("tags")))


@_query("select p_partkey from part where list_has_any(string_split(p_name, ' '), ['green', 'red', 'widget'])")
def tag_any_filter(spark, sf_dir):
    return filters.with_any_tag(table(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " ")), ["green", "red", "widget"]).select("p_partkey")


@_query("""select name, count(*) as count, case when lower(name) in ('', 'uncategorized') then '/archive/?uncategorized=true' else '/archive/?category=' || replace(url_encode(name), '+', '%20') end as url
  from (select case when coalesce(c, '') = '' then 'Uncategorized' else trim(c) end as name from (select case when o_orderpriority = '5-LOW' then null else o_orderpriority end as c from orders)) group by name""")
def category_counts(spark, sf_dir):
    return taxonomy.category_counts(table(spark, sf_dir, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("category")))


@_query("select count(*) as n, count(*) >= 20 as collapsed from (select distinct unnest(string_split(p_name, ' ')) as name from part)")
def tags_collapsed(spark, sf_dir):
    return projections.tags_collapsed(taxonomy.tag_counts(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("tags"))))


_ARCHIVE_URL = "/archive/?tag=URGENT&tag=HIGH&category=1-URGENT&category=2-HIGH&category=3-MEDIUM"
_CHOSEN = "draft is distinct from true and list_has_any(tags, ['URGENT', 'HIGH']) and category in ('1-URGENT', '2-HIGH', '3-MEDIUM')"


def _archived(spark, sf_dir) -> DataFrame:
    q = parameters.archive_query(_ARCHIVE_URL)
    return filters.archive_filter(filters.published_only(order_posts(spark, sf_dir)), list(q.tags), list(q.categories), q.uncategorized)


@_query(_POSTS + f"""select cast(year(published) as bigint) as year, count(*) as n_posts, case when count(*) = 1 then 'post' else 'posts' end as label
  from posts where {_CHOSEN} group by 1""")
def archive_by_year(spark, sf_dir):
    return archive.years(_archived(spark, sf_dir))


@_query(_POSTS + f"""select cast(year(published - interval 5 hour) as bigint) as year, count(*) as n_posts, case when count(*) = 1 then 'post' else 'posts' end as label
  from posts where {_CHOSEN} group by 1""")
def archive_by_year_west(spark, sf_dir):
    """A reader in a zone five hours west of UTC all year: dates at midnight fall into the day before."""
    return archive.years(_archived(spark, sf_dir), tz="-05:00")


@_query(_POSTS + f"""select cast(year(published) as bigint) as year, strftime(published, '%m-%d') as month_day, title, slug,
  '/posts/' || slug || '/' as url, '#' || array_to_string(tags, ' #') as tags_label from posts where {_CHOSEN}""")
def archive_rows(spark, sf_dir):
    return archive.rows(_archived(spark, sf_dir))


@_query(_POSTS + f"""select cast(year(published) as bigint) as year, count(*) as n_posts, string_agg(slug, ',' order by published desc, slug) as slugs
  from posts where {_CHOSEN} group by 1""")
def archive_members(spark, sf_dir):
    found = archive.grouped(_archived(spark, sf_dir))
    return found.select("year", "n_posts", F.array_join(F.transform("posts", lambda p: p["slug"]), ",").alias("slugs"))


@_query(_POSTS + f"""select slug, cast(year(published) as bigint) as year, row_number() over (partition by year(published) order by published desc, slug) as place
  from posts where {_CHOSEN}""")
def archive_places(spark, sf_dir):
    """The members of each year as rows with their places, the form for years of any size."""
    return archive.placed(_archived(spark, sf_dir).select("slug", "published")).select("slug", "year", "place")


@_query("select doc_id from documents where coalesce(nullif(source, (select min(source) from documents)), '') = ''")
def uncategorized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    least = docs.agg(F.min("source").alias("m")).select("m").scalar()
    return filters.without_category(docs.withColumn("category", F.nullif(F.col("source"), least))).select("doc_id")


_WORD_SQL = text.WORD.replace("'", "''")


@_query(f"""select doc_id, words, cast(greatest(1, floor(words / 200.0 + 0.5)) as bigint) as minutes
  from (select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD_SQL}')) as bigint) as words from documents)""")
def reading_time(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))
    return counted.withColumn("minutes", text.reading_minutes(F.col("words")))


# The documents are plain prose: their first block is their first paragraph.
@_query(r"""select doc_id, coalesce(trim((list_filter(regexp_split_to_array(coalesce(text, ''), '\n[ \t]*(?:\n[ \t]*)+'), lambda b: trim(b) <> ''))[1]), '') as excerpt from documents""")
def excerpt(spark, sf_dir):
    return projections.with_metrics(table(spark, sf_dir, "documents").withColumnRenamed("text", "body")).select("doc_id", "excerpt")


@_query("select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then source end, ''), lang) as description from documents")
def description_fallback(spark, sf_dir):
    k = F.col("doc_id") % 3
    docs = table(spark, sf_dir, "documents").withColumn("description", F.when(k == 0, "").when(k == 1, F.col("source")))
    return docs.select("doc_id", text.first_truthy(F.col("description"), F.col("lang")).alias("description"))


_QUERY = "elle reen onst src1"
_TOKENS = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+')"
_HIT = f"list_has_any({_TOKENS('w')}, ['elle', 'reen', 'onst', 'src1'])"


@_query(f"""with raw as (select doc_id, unnest({_TOKENS('text')}) as token, 1 as weight from documents union all select doc_id, unnest({_TOKENS('source')}), 10 from documents),
  t as (select doc_id, token, sum(weight) as tf from raw group by 1, 2), d as (select doc_id, sum(weight) as length from raw group by doc_id),
  s as (select count(*) as n, avg(length) as mean from d), p as (select * from t where token in ('elle', 'reen', 'onst', 'src1')), f as (select token, count(*) as df from p group by token),
  scored as (select p.doc_id as doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from p join f using (token) join d using (doc_id), s group by 1),
  w as (select doc_id as doc, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as words from documents),
  h as (select *, list_position(list_transform(words, lambda w: {_HIT}), true) as first_hit from w)
  select doc, source as title, score, array_to_string(list_transform(words[greatest(1, coalesce(first_hit, 0) - 6):greatest(1, coalesce(first_hit, 0) - 6) + 19],
    lambda w: case when {_HIT} then '<mark>' || w || '</mark>' else w end), ' ') as excerpt from scored join h using (doc)""")
def search_bm25(spark, sf_dir):
    return search.search(_written_index(spark, sf_dir), _QUERY).select("doc", "title", "score", "excerpt")


def _documents_to_search(spark, sf_dir) -> DataFrame:
    """Documents with a heading before every fortieth word from the fortieth on."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit("/d/").alias("url"), F.col("source").alias("title"), F.col("text").alias("content"))
    n = F.size(search.content_words(F.coalesce("content", F.lit(""))))
    places = F.when(n > 40, F.sequence(F.lit(40), n - 1, F.lit(40))).otherwise(F.array().cast("array<int>"))
    heading = lambda p: F.struct(F.concat(F.lit("p"), p.cast("string")).alias("anchor"), F.concat(F.lit("From "), p.cast("string")).alias("text"), F.lit(2).alias("depth"), p.alias("location"))
    return docs.withColumn("headings", F.transform(places, heading))


def _written_index(spark, sf_dir, places: bool = False) -> search.Index:
    """The index, written once and read back: a query reads the parts of its words."""
    path = shared_dir(spark, "index")
    search.build_index(_documents_to_search(spark, sf_dir)).write(path, places)
    return search.Index.read(spark, path, places)


_TF_SQL = f"""raw as (select doc_id, unnest({_TOKENS('text')}) as token, 1 as weight from documents union all select doc_id, unnest({_TOKENS('source')}), 10 from documents),
  t as (select doc_id, token, sum(weight) as tf from raw group by 1, 2), d as (select doc_id, sum(weight) as length from raw group by doc_id), s as (select count(*) as n, avg(length) as mean from d)"""
_BM25_SQL = "sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean)))"


@_query(f"""with {_TF_SQL}, p as (select doc_id, 'src1' as term, tf from t where token = 'src1' union all select doc_id, 'ell*', sum(tf) from t where token like 'ell%' group by 1),
  f as (select term, count(*) as df from p group by term)
  select p.doc_id as doc, round({_BM25_SQL}, 6) as score from p join f using (term) join d using (doc_id), s group by 1""")
def search_typed(spark, sf_dir):
    """A query whose last word is still being typed."""
    return search.search(_written_index(spark, sf_dir), "src1 ell", typed=True).select("doc", "score")


@_query(rf"""with {_TF_SQL}, p as (select * from t where token in ('elle', 'reen', 'onst', 'src1')), f as (select token, count(*) as df from p group by token),
  scored as (select p.doc_id as doc, round({_BM25_SQL}, 6) as score from p join f using (token) join d using (doc_id), s group by 1),
  w as (select doc_id as doc, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as words from documents),
  h as (select doc, source, words, unnest(list_filter(range(0, len(words)), lambda i: list_has_any(regexp_extract_all(lower(words[i + 1]), '[\p{{L}}\p{{N}}]+'), ['elle', 'reen', 'onst', 'src1']))) as place from w),
  g as (select doc, any_value(words) as words, place // 40 as part, list(cast(place as integer) order by place) as locations from h group by doc, place // 40)
  select scored.doc, '/d/' || case when coalesce(part, 0) = 0 then '' else '#p' || part * 40 end as url, w.source as title, score, case when part > 0 then 'From ' || part * 40 end as heading, coalesce(array_to_string(locations, ','), '') as locations,
    array_to_string(list_transform(w.words[greatest(1, coalesce(locations[1], 0) - 5):greatest(1, coalesce(locations[1], 0) - 5) + 19], lambda w: case when {_HIT} then '<mark>' || w || '</mark>' else w end), ' ') as excerpt
  from scored join w using (doc) left join g using (doc)""")
def search_sub_results(spark, sf_dir):
    """Each found document's headings with hits below, their places and an excerpt each."""
    found = search.sub_results(_written_index(spark, sf_dir, places=True), _QUERY)
    return found.select("doc", "url", "title", "score", "heading", F.array_join(F.col("locations").cast("array<string>"), ",").alias("locations"), "excerpt")


@_query(f"""with {_TF_SQL}, p as (select * from t where token in ('elle', 'reen', 'onst', 'src1')), f as (select token, count(*) as df from p group by token),
  scored as (select p.doc_id as doc, {_BM25_SQL} as score from p join f using (token) join d using (doc_id), s group by 1)
  select doc, source as title, round(score, 6) as score from scored join documents on doc = doc_id order by round(scored.score, 9) desc, doc limit 10""")
def search_best(spark, sf_dir):
    """The ten best by a packed index, whose other ranges of documents are passed over."""
    path = shared_dir(spark, "packed")
    search.packed(search.build_index(_documents_to_search(spark, sf_dir)), size=64).write(path)
    best, _ = search.best_of(search.PackedIndex.read(spark, path), _QUERY, 10, size=64)
    return best.select("doc", "title", "score")


@_query(f"with {_TF_SQL} select token, doc_id as doc, cast(tf as bigint) as tf from t")
def packed_index(spark, sf_dir):
    """All postings, from the packed index as it is written."""
    path = shared_dir(spark, "packed")
    search.packed(search.build_index(_documents_to_search(spark, sf_dir)), size=256).write(path)
    return search.unpacked_postings(search.PackedIndex.read(spark, path), 256).select("token", "doc", F.col("tf").cast("long").alias("tf"))


def _decoded_sql(x: str) -> str:
    """The entities that the pages have."""
    for name, sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{sign}')"
    return x


_TITLE_SQL = "regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)"
_SHOWN_SQL = r"regexp_replace(regexp_replace(body, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"


@_query(rf"""with t as (select page_id, trim({_decoded_sql(_TITLE_SQL)}) as title,
    regexp_replace(regexp_replace(coalesce(html, ''), '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis') as body from pages)
  select page_id, title, trim(regexp_replace({_decoded_sql(_SHOWN_SQL)}, '\s+', ' ', 'g')) as text from t""")
def html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html.html_title(F.col("html")).alias("title"), html.html_text(F.col("html")).alias("text"))


@_query("select p_partkey, '/archive/?tag=' || replace(url_encode(p_name), '+', '%20') as url from part")
def tag_url(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", urls.tag_url(F.col("p_name")).alias("url"))


@_query("""with h as (select conv_id as doc, turn as pos, case role when 'system' then 1 when 'user' then 2 else 3 end as depth, coalesce(text, '') as text from conversations),
  m as (select *, depth - min(depth) over (partition by doc) as indent, sum(0) over () as z from h),
  n as (select *, count(case when indent = 0 then 1 end) over (partition by doc order by pos rows between unbounded preceding and current row) as num from m)
  select doc, pos, cast(indent as bigint) as indent, case when indent = 0 then num end as number, regexp_replace(text, '#$', '') as text from n where indent < 2""")
def toc_contents(spark, sf_dir):
    depth = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    found = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), depth.alias("depth"), slugged(F.col("role")).alias("slug"), F.coalesce("text", F.lit("")).alias("text"))
    return toc.contents(found).select("doc", "pos", F.col("indent").cast("long").alias("indent"), "number", "text")


@_query("""with h as (select conv_id as doc, turn as pos, role = 'assistant' as active from conversations),
  l as (select doc, max(pos) as last from h where active group by doc),
  b as (select l.doc, l.last, max(case when not coalesce(h.active, false) and h.pos < l.last then h.pos end) as broken from l join h using (doc) group by 1, 2)
  select b.doc, min(h.pos) as first_pos, max(h.pos) as last_pos from b join h using (doc) where h.pos <= b.last and h.pos > coalesce(b.broken, -1) group by b.doc""")
def toc_visible_run(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), (F.col("role") == "assistant").alias("active"))
    return toc.visible_run(found)


@_query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def asset_missing(spark, sf_dir):
    name = lambda c: F.concat(F.lit("images/./"), F.col(c).cast("string"), F.lit(".png"))
    docs = table(spark, sf_dir, "documents").select("doc_id", name("doc_id").alias("image"))
    assets = table(spark, sf_dir, "labels").select(F.concat(F.lit("images/x/../"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return lookup.missing_assets(docs, assets).select("doc_id")


@_query("select doc_id, case lower(lang) when 'es' then 'Archivo' else 'Archive' end as text from documents")
def i18n_lookup(spark, sf_dir):
    texts = lookup.english(spark).unionByName(spark.createDataFrame([("es", "archive", "Archivo")], "lang string, key string, text string"))
    return lookup.translated(table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("archive").alias("key")), texts).select("doc_id", "text")


@_query(r"""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, regexp_replace(o_orderpriority || '_x_y', '^([^_]*)_', '\1-') as tag,
  case when o_custkey % 5 = 1 then '/' else '/' || cast(o_custkey % 5 as varchar) || '/' end as page, 'Order ' || o_orderkey || ' - Site' as page_title from orders""")
def labels_of_posts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.iso_date(F.col("o_orderdate")).alias("day"), text.language_tag(F.concat("o_orderpriority", F.lit("_x_y"))).alias("tag"),
        urls.page_url(F.col("o_custkey") % 5).alias("page"), text.page_title(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "Site", "").alias("page_title"),
    )


@_query("""select doc_id, coalesce(source, '') as description, '/posts/' || doc_id || '/' as link, regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{7F}-\\x{9F}\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}]', '', 'g') as content from documents""")
def rss_items(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("slug"), F.col("doc_id").cast("string").alias("title"), F.lit(None).cast("timestamp").alias("published"),
        F.col("source").alias("description"), F.col("text").alias("body"),
    )
    return sinks.rss_items(docs).select(F.col("title").cast("long").alias("doc_id"), "description", "link", "content")


@_query("""select cast(doc_id as varchar) as slug, cast(json_object('@context', 'https://schema.org', '@type', 'BlogPosting', 'headline', source, 'description', source,
  'keywords', json_array(lang), 'author', json_object('@type', 'Person', 'name', '', 'url', 'https://example.org'), 'datePublished', '2025-01-01', 'inLanguage', coalesce(nullif(lang, ''), 'en')) as varchar) as json
  from documents""")
def jsonld(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("slug"), F.col("source").alias("title"), F.lit("2025-01-01").cast("timestamp").alias("published"),
        F.lit("").alias("description"), F.array("lang").alias("tags"), "lang",
    )
    return sinks.json_ld(docs)


@_query(_POSTS + """, n as (select count(*) as n from posts)
  select 'https://example.org/posts/' || slug || '/' as url from posts
  union all select case when p = 1 then 'https://example.org/' else 'https://example.org/' || p || '/' end from (select unnest(range(1, cast(ceil(n / 8.0) as bigint) + 1)) as p from n)
  union all select 'https://example.org/archive/' union all select 'https://example.org/about/'""")
def sitemap(spark, sf_dir):
    return sinks.sitemap(order_posts(spark, sf_dir), Site())


@_query("select conv_id, turn, (((turn - 3) % 7) + 7) % 7 as idx, printf('%d:%02d', (turn * 47) // 60, (turn * 47) % 60) as at from conversations")
def ring_next(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", playlist.ring_index(F.col("turn") - 3, F.lit(7)).alias("idx"), dates.track_time(F.col("turn") * 47).alias("at"))


@_query(None)
def shuffle_pick(spark, sf_dir):
    """A track of the playlist of all pages other than the fifth."""
    tracks = table(spark, sf_dir, "pages").select(F.col("url").alias("title"), F.lit("").alias("artist"), F.col("url").alias("src"), F.col("page_id").cast("int").alias("idx"))
    return playlist.shuffled_next(tracks, 4, seed=7)
