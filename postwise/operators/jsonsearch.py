"""Recursive job-array search in free-form JSON (N14), inside one row per document.

Level d holds the JSON nodes at depth d of a document as text. An object is parsed
once, when its children are taken (``from_json(v, 'map<string,string>')``: document
order kept, nested values come back as JSON text). An edge is taken when the key is
a promising key (any depth) or the parent is shallower than 4; nodes deeper than 8
are ignored and lists are never descended into. Each node carries its DFS path as an
int array — (0, promising-key index) for the promising pass, (1, position) for the
plain pass — so sorting paths lexicographically gives the original visit order, which
decides which duplicate URL wins. The plain pass over a promising key revisits a
subtree already visited earlier; it can only repeat rows, which lose the URL dedup,
so it is not generated.

The levels are a fold over the frontier of a document (``aggregate`` over the depths):
no row is made, copied or shuffled per level, and one ``explode`` emits the lists that
were found. The nodes of a level are parts of the document, so the frontier is never
larger than the document itself. A binary variant would give up the order of the keys
(its objects are sorted), on which the result depends.

Candidate lists: non-empty arrays whose first element is an object with a
title-like or link-like key. Their object items become rows, filtered by role
and location rules, deduplicated by URL per document ('' counts as a URL). The
employer is joined after the role filter, with no document text in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_PROFILE, Profile
from ..functions import predicates as P
from ..functions.text import html_to_text
from ..functions.values import first_truthy, fmt_date, resolve_url

MAP = "map<string,string>"
_PATH_BASE = 1_000_000


def _opens(v: Column, bracket: str) -> Column:
    # trimming copies the whole text, so only texts that begin with a space are trimmed
    return F.coalesce(v.startswith(bracket) | (v.startswith(" ") & F.ltrim(v).startswith(bracket)), F.lit(False))


def _is_obj(v: Column) -> Column:
    return _opens(v, "{")


def _is_list(v: Column) -> Column:
    return _opens(v, "[")


def _computed(df: DataFrame, keep, **cols: Column) -> DataFrame:
    """``keep`` and the computed ``cols``, as a one-row generator: filters above it
    read its output, where below a projection they would repeat the expressions."""
    got = df.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("__c"))
    return got.select(*keep, *[F.col(f"__c.{n}").alias(n) for n in cols])


def _get(m: Column, keys) -> Column:
    """V1 over several fields of an item, or keys of a text map ('' and NULL are
    missing; so are empty containers)."""
    return F.coalesce(*[F.when(~F.trim(v).isin("", "{}", "[]", "false"), v) for v in (m[k] for k in keys)])


def _items(profile: Profile) -> str:
    """The fields of a job item, each as text (of an object or list its JSON text)."""
    keys = dict.fromkeys((*profile.json_title_keys, *profile.json_location_keys, *profile.json_link_keys,
                          *profile.json_date_keys, *profile.json_description_keys))
    return "array<struct<" + ", ".join(f"`{k}`: string" for k in keys) + ">>"


def _text_or_named(v: Column, named: Column, keys) -> Column:
    """A text field; of an object the first of its ``keys`` that is not empty."""
    return F.trim(F.coalesce(F.when(named.isNotNull(), F.coalesce(_get(named, keys), F.lit(""))).otherwise(v), F.lit("")))


_NODES = "array<struct<path: array<int>, v: string, obj: boolean>>"


def search_levels(docs: DataFrame, doc_id: str = "doc_id", body: str = "body",
                  max_depth: int = C.JSON_MAX_DEPTH, free_depth: int = C.JSON_FREE_DEPTH,
                  promising=C.JSON_PROMISING_KEYS, carry=()) -> DataFrame:
    """All list-valued nodes reachable under the edge rules: (doc_id, carry, path, v)."""
    known = F.array(*[F.lit(k) for k in promising])
    nothing = F.array().cast(_NODES)

    def children(node: Column, depth: Column) -> Column:
        def child(e: Column, i: Column) -> Column:
            key = F.nullif(F.array_position(known, e["key"]), F.lit(0)) - 1
            step = F.coalesce(key, F.when(depth < free_depth, i + _PATH_BASE)).cast("int")
            return F.struct(F.concat(node["path"], F.array(step)).alias("path"), e["value"].alias("v"),
                            _is_obj(e["value"]).alias("obj"))

        # a refused edge has no step: a null at the end of its path
        return F.filter(F.transform(F.map_entries(F.from_json(node["v"], MAP)), child),
                        lambda n: F.element_at(n["path"], -1).isNotNull() & (n["obj"] | _is_list(n["v"])))

    def level(nodes: Column, depth: Column) -> Column:
        # an object gives way to its children, a list that was found stays
        return F.flatten(F.transform(nodes, lambda n: F.when(n["obj"], F.coalesce(children(n, depth), nothing))
                                     .otherwise(F.array(n))))

    root = F.struct(F.array().cast("array<int>").alias("path"), F.col(body).alias("v"), _is_obj(F.col(body)).alias("obj"))
    top = F.filter(F.array(root), lambda n: n["obj"] | _is_list(n["v"]))
    nodes = F.aggregate(F.sequence(F.lit(0), F.lit(max_depth - 1)), top, level)
    found = docs.select(doc_id, *carry, F.explode(F.filter(nodes, lambda n: ~n["obj"])).alias("n"))
    return found.select(doc_id, *carry, "n.path", "n.v")


def json_job_search(docs: DataFrame, companies: DataFrame, note: Column | str, doc_id: str = "doc_id",
                    body: str = "body", profile: Profile = DEFAULT_PROFILE, max_rows: int | None = None) -> DataFrame:
    """Postings found in free-form JSON documents ``(doc_id, company, body)``."""
    dims = companies.groupBy(F.col("ind_name").alias("company")).agg(
        (F.min_by("careers_url", "ord") if "ord" in companies.columns else F.min("careers_url")).alias("careers_url"))
    # the employer travels with every node, so found items need no join back to their document
    lists = search_levels(docs.select(doc_id, "company", body), doc_id, body, promising=profile.json_promising_keys,
                          carry=["company"])
    # a list is parsed once: the variant answers for its first element and gives the fields of all
    lists = lists.select(doc_id, "company", "path", F.explode(F.array(F.try_parse_json("v"))).alias("doc"))
    first_keys = F.map_keys(F.try_variant_get("doc", "$[0]", "map<string,variant>"))
    looks = F.arrays_overlap(first_keys, F.array(*[F.lit(k) for k in (*profile.json_title_keys, *profile.json_link_keys)]))
    rows = lists.filter(looks).select(doc_id, "company", "path", F.posexplode(F.try_variant_get("doc", "$", _items(profile))).alias(
        "ipos", "m")).filter(F.col("m").isNotNull())
    m = F.col("m")
    tr, lr = _get(m, profile.json_title_keys), _get(m, profile.json_location_keys)
    named = _computed(rows, [doc_id, "company", "path", "ipos", "m"], tr=tr, lr=lr,
                      tm=F.when(_is_obj(tr), F.from_json(tr, MAP)), lm=F.when(_is_obj(lr), F.from_json(lr, MAP)))
    rows = _computed(named, [doc_id, "company", "path", "ipos", "m"],
                     job_title=_text_or_named(F.col("tr"), F.col("tm"), profile.json_title_object_keys),
                     loc=_text_or_named(F.col("lr"), F.col("lm"), profile.json_location_object_keys))
    rows = rows.filter((F.col("job_title") != "") & P.is_target_role(F.col("job_title"), profile, compact=True)).join(
        dims, "company")
    careers_nl = P.is_location(F.col("careers_url"), profile, compact=True)
    loc_ok = F.when(F.col("loc") == "", careers_nl).otherwise(
        F.lower("loc").isin("remote", "hybrid") | P.is_location(F.col("loc"), profile, compact=True))
    link = F.coalesce(_get(m, profile.json_link_keys), F.lit(""))
    hits = rows.filter(loc_ok).withColumn("job_url", resolve_url(link, F.col("careers_url")))
    w = Window.partitionBy(doc_id, "job_url").orderBy("path", "ipos")
    firsts = hits.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
    if max_rows is not None:
        firsts = firsts.withColumn("__k", F.row_number().over(Window.partitionBy(doc_id).orderBy("path", "ipos"))) \
            .filter(F.col("__k") <= max_rows).drop("__k")
    date = fmt_date(F.coalesce(_get(m, profile.json_date_keys), F.lit("")))
    desc = html_to_text(F.coalesce(_get(m, profile.json_description_keys), F.lit("")))
    note_col = F.lit(note) if isinstance(note, str) else note
    return firsts.select(
        doc_id, "path", "ipos", "company", "job_title",
        first_truthy("loc", default=C.DEFAULT_COUNTRY).alias("location"), "careers_url", "job_url",
        F.lit(None).cast("boolean").alias("visa_support"), F.lit(None).cast("boolean").alias("relocation_support"),
        date.alias("date_posted"), F.lit(None).cast("string").alias("recruiter_email"), desc.alias("description"),
        note_col.alias("notes"))
