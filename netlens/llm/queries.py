"""Registered queries of this subpackage, each over its whole table, and the SQL they are compared with."""

from __future__ import annotations

import uuid
import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import decontaminate, host_quality, licenses, line_dedup, manifest, mixing, pieces, secrets, simhash, token_files, toxicity, url_filter, whitening
from netlens.llm.license_rules import default_rules
from netlens.llm.common import remainder, shared_folder, table


#: No table holds labelled findings; those whose form is beyond doubt are labelled by it. Fixed values.
SURE_SECRET = r"^AKIA[0-9A-Z]{16}$"
SURE_NAME = r"(password|token|secret|api_?key)\W*$"
SURE_FALSE = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9]{12,19}|[a-z0-9-]+(\.[a-z0-9-]+)*\.(com|net|org))$"


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.with_features(secrets.candidates(docs), docs)
    held_out = remainder(F.col("key"), 5) == 0
    value = F.col("value")
    label = F.when(value.rlike(SURE_SECRET), 1).when(value.rlike(SURE_FALSE), 0).when(F.col("name").rlike(SURE_NAME), 1)
    model = secrets.fit(found, F.when(~held_out, label))
    return secrets.verify(found, model).select(
        F.col("key").alias("doc_id"),
        "position",
        F.sha2("value", 256).alias("value_sha256"),
        held_out.alias("held_out"),
        label.alias("label"),
        F.round("probability", 9).alias("probability"),
        (F.col("probability") >= 0.5).alias("kept"),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = mixing.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) != 0)
    return scores.withColumn("held_out", ~F.col("learned")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    files = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    found = token_files.look_up(files, files.places.select("key")).union(files.places.where("key is null"))
    sums = token_files.read_back(files, found, lambda ids: (len(ids), zlib.crc32(ids.tobytes())), "n_tokens long, ids_crc32 long")
    base = F.broadcast(token_files.base_of(spark, files.places))  # one row for each file
    return sums.join(base, "file").select(
        F.col("key").alias("doc_id"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


#: Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _attribute_sql(name: str) -> str:
    pattern = rf"""(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return "trim(" + " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3)) + ")"


OP3_SQL = r"""
with recursive base as (
    select page_id, url, html, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
    from pages
), tags as (
    select page_id, url, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) as tag from base
), attributes as (
    select *, tag ilike '<link%' as link, {rel} as rel, {property} as property, {equiv} as equiv, {href} as href, {content} as content from tags
), raw as (
    select page_id, url, host, path, case when link and list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') then href
        when not link and lower(property) = 'og:url' then content
        when not link and lower(equiv) = 'refresh' then regexp_extract(content, '(?is)\burl\s*=\s*[''"]?([^"''\s>]+)', 1) end as x
    from attributes
), split as (
    select page_id, url, path, x, regexp_extract(url, '(?s)^(.*?)://', 1) as scheme, host, regexp_extract(x, '(?s)^[^?#]*') as xpath
    from raw where x <> ''
), merged as (
    select *, case when xpath like '/%' then xpath else regexp_replace('/' || regexp_replace(path, '^/', ''), '[^/]*$', '') || xpath end as whole
    from split
), goals as (
    select page_id, case when x like '#%' then null
        when regexp_matches(x, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://') then x
        when x like '//%' then scheme || ':' || x
        when regexp_matches(x, '(?s)^[A-Za-z][A-Za-z0-9+.-]*:') then null
        when x like '?%' then scheme || '://' || host || path || x
        else scheme || '://' || host || list_reduce(list_prepend('', string_split(whole, '/')[2:]), lambda d, p: case
            when p = '..' then regexp_replace(d, '/[^/]*$', '') when p = '.' then d else d || '/' || p end)
            || case when regexp_matches(whole, '(?s)/\.\.?$') then '/' else '' end || substr(x, length(xpath) + 1) end as url
    from merged
), urls as (
    select page_id, url, true as own from base union all select page_id, url, false from goals where url is not null
), parsed as (
    select page_id, own, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
        array_to_string(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
            lambda q: q <> '' and not lower(q) like 'utm\_%' escape '\'), '&') as query
    from urls
), ruled as (
    select *, case when contains(url, '://') and host <> '' then
            host || regexp_replace(path, '/$', '') || case when query <> '' then '?' || query else '' end end as node,
        case when ('.' || host) like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/'
            when ('.' || host) like '%.example.com' and path like '/en/%' then 'example.com/en/'
            when ('.' || host) like '%.net' and path like '/es/%' then 'net/es/'
            when ('.' || host) like '%.net' and path like '/fr/%' then 'net/fr/'
            when ('.' || host) like '%.com' and path like '/%' then 'com/' end as rule
    from parsed
), judged as (
    select *, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as verdict
    from ruled
), links as (
    select a.node as a, b.node as b from judged a join judged b using (page_id)
    where a.own and not b.own and a.node <> b.node
), pairs as (
    select a, b from links union select b, a from links
), reach as (
    select a as node, b as other from pairs union select r.node, l.b from reach r join pairs l on r.other = l.a
), bad as (
    select node from judged where verdict = 'block' and node is not null
    union select r.other from reach r join judged j on j.node = r.node and j.verdict = 'block'
)
select page_id, host, path, rule,
    coalesce(verdict, case when node in (select node from bad) then 'block' else 'allow' end) as verdict
from judged where own
"""
for _name, _attribute in (("rel", "rel"), ("property", "property"), ("equiv", "http-equiv"), ("href", "href"), ("content", "content")):
    OP3_SQL = OP3_SQL.replace("{" + _name + "}", _attribute_sql(_attribute))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model, decoded="decoded").select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.xxhash64("token_ids").alias("ids_xxhash64"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.equal_null("decoded", "text").alias("round_trip"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
with lines as (
    select doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from (select doc_id, unnest(l) as line, unnest(range(len(l))) as pos
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))
), held as (
    select k, min(doc_id) as first from lines where length(k) >= 10 group by k having count(distinct doc_id) > 1
), marked as (
    select l.*, h.first is not null and l.doc_id <> h.first as gone from lines l left join held h on l.k = h.k
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 9) for c in ("short_rate", "repeats_rate")})


OP7_SQL = r"""
with t as (
    select doc_id, source as host, coalesce(text, '') as text from documents
), w as (
    select doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
    from t
), grams as (
    select doc_id, pos, ws[pos:pos + 4] as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as pos from w)
), again as (
    select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, g) as n from grams) where n > 1
), covered as (
    select doc_id, sum(least(5, coalesce(next - pos, 5)))::bigint as n
    from (select doc_id, pos, lead(pos) over (partition by doc_id order by pos) as next from again) group by doc_id
), numbers as (
    select doc_id, host, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0) as n_repeat_words
    from w left join covered using (doc_id)
), judged as (
    select *, n_words < 10 as short, 100 * n_repeat_words > 20 * n_words as repeats from numbers
), hosts as (
    select host, count(*) as n, count(*) filter (short) as s, count(*) filter (repeats) as r
    from judged where host is not null group by host
), mean as (
    select sum(n) as n, count(*) as h, sum(s) / sum(n) as ms, sum(r) / sum(n) as mr from hosts
), prior as (
    select any_value(ms) as ms, any_value(mr) as mr,
        sum(hosts.n * (s / hosts.n - ms) ^ 2) / any_value(mean.n) - any_value(ms * (1 - ms) * h / mean.n) as vs,
        sum(hosts.n * (r / hosts.n - mr) ^ 2) / any_value(mean.n) - any_value(mr * (1 - mr) * h / mean.n) as vr
    from hosts, mean
), strength as (
    select ms, mr, case when vs > 0 and ms * (1 - ms) > 0 then greatest(ms * (1 - ms) / vs - 1, 0) end as ks,
        case when vr > 0 and mr * (1 - mr) > 0 then greatest(mr * (1 - mr) / vr - 1, 0) end as kr
    from prior
), rates as (
    select host, case when ks is null then ms else (s + ms * ks) / (n + ks) end as short_rate,
        case when kr is null then mr else (r + mr * kr) / (n + kr) end as repeats_rate
    from hosts, strength
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short or repeats as base_failed,
    not short and not repeats and not coalesce(greatest(short_rate, repeats_rate) > 0.5, false) as kept,
    round(short_rate, 9) as short_rate, round(repeats_rate, 9) as repeats_rate
from judged left join rates using (host)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "rejected",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = manifest.leaf_of(*map(F.col, MANIFEST_FIELDS[:-1]), plain)
    docs = docs.withColumn("tampered", F.when(remainder(F.col("doc_id"), 3) == 0, tampered))
    proved = manifest.manifest(docs, MANIFEST_FIELDS, keep=["tampered"])
    folded = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    proved = proved.withColumns({"proof_sha256": manifest.siblings_digest(F.col("proof")), "folded_root": folded})
    return proved.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _manifest_sql(levels: int = 8, upper: int = 3) -> str:
    """Levels one by one; enough for 8^8 documents of a language and 8^3 languages."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, MANIFEST_FIELDS[:-1]), field(text)]) + ")"
    # crc32 by its table, which is the polynomial divided bit by bit
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    parts = [
        f"""crc as (select list(c order by k) as t from (with recursive r(k, i, c) as (
            select range::bigint, 0, range::bigint from range(256) union all select k, i + 1, {step} from r where i < 8)
            select k, c from r where i = 8))""",
        """sums(doc_id, c) as (select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''),
            lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)
            from (select distinct doc_id from documents), crc)""",
        f"""n0 as (select coalesce('+' || lang, '') as g, row_number() over (partition by lang order by d.doc_id) - 1 as p, d.doc_id,
            {leaf("text")} as h, case when c % 3 = 0 then {leaf(lowered)} else {leaf("text")} end as f
            from documents d join sums using (doc_id))""",
    ]

    def tree(name: str, up_to: int) -> None:
        for k in range(up_to):
            parts.append(f"""{name}{k}c as (select g, p, h, count(*) over (partition by g) as c from {name}{k})""")
            parts.append(f"""{name}{k + 1} as (select g, p // 8 as p, case when max(c) = 1 then max(h) else
                sha256(string_agg(h, '' order by p)) end as h from {name}{k}c group by g, p // 8)""")
            parts.append(f"""{name}{k}s as (select a.g, a.p, max(a.c) as c,
                coalesce(string_agg(b.h, '' order by b.p) filter (b.p < a.p), '') as l,
                coalesce(string_agg(b.h, '' order by b.p) filter (b.p > a.p), '') as r
                from {name}{k}c a join {name}{k}c b on a.g = b.g and a.p // 8 = b.p // 8 group by a.g, a.p)""")

    tree("n", levels)
    parts.append(f"u0 as (select '' as g, row_number() over (order by g) - 1 as p, h, g as of from n{levels})")
    tree("u", upper)
    parts.append("f0 as (select n0.g, n0.p, doc_id, n0.h, f, '' as s, u0.p as up, u0.h as subroot from n0 join u0 on n0.g = u0.of)")
    k = 0
    for name, at, count in (("n", "p", levels), ("u", "up", upper)):
        on = "s.g = x.g and" if name == "n" else ""
        for j in range(count):
            parts.append(f"""f{k + 1} as (select x.* replace (case when c = 1 then f else sha256(l || f || r) end as f,
                x.s || case when c = 1 then '' else l || r end as s)
                from f{k} x join {name}{j}s s on {on} s.p = x.{at} // {8**j})""")
            k += 1
    return f"""with {", ".join(parts)}
        select doc_id, f{k}.h as leaf, subroot, u{upper}.h as root, sha256(s) as proof_sha256, f as folded_root, f = u{upper}.h as verified
        from f{k}, u{upper}"""


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(table(spark, sf_dir, "documents"))
    return licenses.labelled(scanned, licenses.detections(scanned)).withColumnRenamed("key", "doc_id")


def _licenses_sql() -> str:
    """Every rule on every text with its keyword; suppression by comparing all detections of a text."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(
        f"({k}, {text(r.label)}, {text(r.keyword)}, {text(r.regex)}, {r.priority}, {r.confidence}, {r.base})"
        for k, r in enumerate(default_rules())
    )
    return rf"""
with rules(rule, label, keyword, regex, priority, confidence, base) as (values {rules}
), texts as (
    select row_number() over () as uid, doc_id, regexp_replace('  ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') || '  ', '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g') as words
    from documents
), hits as (
    select uid, rules.*, string_split_regex(words, regex) as gaps, regexp_extract_all(words, regex) as found
    from texts join rules on contains(words, keyword)
), places as (
    select uid, rule, label, priority, confidence, base, unnest(range(len(found))) as k, unnest(found) as match, unnest(gaps[1:len(found)]) as gap
    from hits
), counted as (
    select *, (length(match) - length(replace(match, ' ', ''))) // 2 as size, (length(gap) - length(replace(gap, ' ', ''))) // 2 as before from places
), spans as (
    select *, (sum(before + size) over (partition by uid, rule order by k))::bigint as stop from counted
), dets as (
    select *, stop - size as start from spans
), judged as (
    select d.*, not exists (select 1 from dets o where o.uid = d.uid and o.start <= d.start and o.stop >= d.stop and
        (o.priority > d.priority or o.priority = d.priority and (o.size > d.size or o.size = d.size and o.rule < d.rule))) as kept
    from dets d
), per_text as (
    select uid, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
        array_to_string(list_sort(list_distinct(list(label) filter (base))), ',') as base_labels,
        array_to_string(list_sort(list_distinct(list(label) filter (base or kept))), ',') as labels,
        max(confidence) filter (kept) as score
    from judged group by uid
)
select doc_id, (length(words) - length(replace(words, ' ', ''))) // 2 - 1 as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
    coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from texts left join per_text using (uid)"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_token_files,
        op3_url_filter,
        op4_secrets,
        op5_pieces,
        op6_line_dedup,
        op7_host_quality,
        op8_toxicity,
        op9_simhash,
        op10_decontaminate,
        op11_manifest,
        op12_licenses,
        op13_whitening,
    )
}
SQL: dict[str, str] = {
    "op3_url_filter": OP3_SQL,
    "op7_host_quality": OP7_SQL,
    "op6_line_dedup": OP6_SQL,
    "op11_manifest": _manifest_sql(),
    "op12_licenses": _licenses_sql(),
}
