"""Secret scans with multipart credential linking (operator 7), in DataFrame functions only.

Method: patterns find three base kinds (assign, access, hex), which are always reported, and weak
candidates that are no evidence alone. Parts of a document are interval-joined within scopes: a weak
candidate is reported only when a part of a complementary kind lies in its scope (``COMPANY``):

    key        40 letters and digits of mixed case        with an access identifier
    short      an assignment of 6 to 11 characters        with an access identifier, endpoint or user
    endpoint   a URL                                      with an access identifier, assigned secret or token
    user       an assigned user name or client id         with an assigned secret or access identifier
    token      a string with a service's prefix           with an endpoint, user, assigned secret or access identifier
    pem_begin  head and body of a private key             with its end line, and the other way round
    conn       a URL that holds a user and a password     has its parts within itself: always

Scope: by default the gap between two spans (from the end of one to the start of the other, 0 where
they overlap) is at most ``radius`` code points, however long they are; with ``scope`` "line" or
"block" (text between empty lines) they begin in the same one instead. The join is a sort-merge over a
document's parts in order of place: of each complementary kind the part that reaches furthest among
those that begin before, and the next one that begins after, decide, so no pairs are made.

A text is split at a pattern's matches; the running sum of the lengths of gaps and matches gives the
places (code points, end exclusive). Only parts are shuffled, by row.

Cases: null text is empty; a row without parts has empty spans; repeated rows and ids are apart
(rows are told apart by ``monotonically_increasing_id``); an empty table gives an empty result; a weak
span that a base span holds whole is left out; extra columns are left out by ``find_secrets`` and kept
by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.session import free_name, numbered

#: The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # greedy runs: the same spans as AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # likewise
#: Patterns of weak candidates.
KEY = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*"
USER = r"""(?i)(?:user|username|login|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
TOKEN = r"(?:gh[pousr]_|github_pat_|xox[abprs]-|glpat-|sk_live_)[A-Za-z0-9_-]{10,}"
PEM_BEGIN = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*"
PEM_END = r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
CONN = r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@\"'<>]+:[^\s/@\"'<>]+@[^\s\"'<>]+"
BREAKS = {"line": r"\n", "block": r"\n[\x20\t\r]*\n"}
KINDS = ("assign", "access", "hex", "key", "short", "endpoint", "user", "token", "pem_begin", "pem_end", "conn")
BASE = KINDS[:3]
COMPANY = {
    "key": ("access",), "short": ("access", "endpoint", "user"), "endpoint": ("access", "assign", "token"), "user": ("assign", "access"),
    "token": ("endpoint", "user", "assign", "access"), "pem_begin": ("pem_end",), "pem_end": ("pem_begin",),
}
#: Parts that are no secrets themselves: reported, not redacted.
OPEN = ("endpoint", "user")
LEAST_VALUE = 12
SHORT_VALUE = 6
SCOPE = 200
MARK = "[SECRET]"


def _parts(text: Column, pattern: str, kind: str, when: Column, group: int = 0) -> Column:
    """array<struct<kind, gap, len, value>> of a pattern's matches in order; empty unless ``when``."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array()).alias("value"),
    )
    found = F.transform(zipped, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["all"]), F.lit(0)).alias("len"), (F.coalesce(F.length(x["value"]), F.lit(0)) if group else F.lit(0)).alias("value")))
    return F.when(when, found).otherwise(F.array().cast("array<struct<kind:string,gap:int,len:int,value:int>>"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = SCOPE, scope: str = "radius", row_col: str | None = None) -> DataFrame:
    """A row per document: row (its number), id_col, spans array<struct<start, ord, end, kind, base>>
    by start, then kind as listed in KINDS. ``row_col``: a column that already numbers the rows."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    base = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    any_of = lambda *words: F.array_max(F.array(*[text.contains(w) for w in words]))
    assigned, token = text.rlike(ASSIGN), text.rlike(TOKEN)
    strong = assigned | text.contains("AKIA")
    pem = text.contains("PRIVATE KEY-----")
    parts = [
        _parts(text, ASSIGN, "assign", assigned, 2),
        _parts(text, ACCESS, "access", text.contains("AKIA")),
        _parts(text, HEX, "hex", text.rlike(HEX)),
        _parts(text, KEY, "key", text.contains("AKIA")),
        _parts(text, ENDPOINT, "endpoint", any_of("http://", "https://") & (strong | token)),
        _parts(text, USER, "user", strong | token),
        _parts(text, TOKEN, "token", token),
        _parts(text, PEM_BEGIN, "pem_begin", pem),
        _parts(text, PEM_END, "pem_end", pem),
        _parts(text, CONN, "conn", text.contains("://") & text.contains("@")),
    ]
    if scope != "radius":
        parts.append(_parts(text, BREAKS[scope], "break", strong | token | pem))
    rows = base.select("row", "__id", F.posexplode_outer(F.concat(*parts))).select("row", "__id", "pos", "col.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    short = (F.col("kind") == "assign") & (F.col("value") < LEAST_VALUE)
    # what is no part (the gap after the last match, a value of a few characters) stays as an empty row of its document
    part = (F.col("len") > 0) & (~short | (F.col("value") >= SHORT_VALUE))
    placed = placed.withColumn("kind", F.when(part, F.when(short, F.lit("short")).otherwise(F.col("kind"))))

    own = Window.partitionBy("row").orderBy("start")
    before, after = own.rangeBetween(Window.unboundedPreceding, Window.currentRow), own.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    placed = placed.withColumn("place", F.lit(0) if scope == "radius" else F.count_if(F.col("kind") == "break").over(own.rangeBetween(Window.unboundedPreceding, -1)))
    kind = F.col("kind")
    if scope == "radius":
        near = {c: (F.col("start") - F.max(F.when(kind == c, F.col("end"))).over(before) <= radius) | (F.min(F.when(kind == c, F.col("start"))).over(after) - F.col("end") <= radius) for c in {c for x in COMPANY.values() for c in x}}
    else:
        near = {c: F.max(kind == c).over(Window.partitionBy("row", "place")) for c in {c for x in COMPANY.values() for c in x}}
    is_base = kind.isin(*BASE)
    linked = kind == "conn"
    for k, company in COMPANY.items():
        found = F.lit(False)
        for c in company:
            found = found | F.coalesce(near[c], F.lit(False))
        linked = linked | ((kind == k) & found)
    joined = placed.select("row", "__id", "kind", "start", "end", is_base.alias("base"), linked.alias("linked"), F.max(F.when(is_base, F.col("end"))).over(before).alias("covered"))
    shown = F.col("base") | (F.col("linked") & (F.coalesce("covered", F.lit(0)) < F.col("end")))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.when(shown, F.struct("start", order.alias("ord"), "end", "kind", "base"))
    return joined.groupBy("row", "__id").agg(F.sort_array(F.collect_list(span)).alias("spans")).withColumnRenamed("__id", id_col)


def named(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = MARK) -> DataFrame:
    """``docs`` with every reported span (or run of overlapping spans) but those of ``OPEN`` kinds
    replaced by ``mark``; null texts stay null. Rows are numbered and cut first, so that both sides of
    the join agree on them."""
    columns = docs.columns
    kept, row = numbered(docs, "rows")
    cuts_name = free_name(kept.columns, "cuts")
    hidden = F.filter("spans", lambda s: ~s["kind"].isin(*OPEN))
    found = find_secrets(kept, id_col, text_col, row_col=row).select(F.col("row").alias(row), hidden.alias("spans")).where(F.size("spans") > 0)
    # spans that begin before an earlier one ends grow that one
    merged = F.aggregate("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))))))
    joined = kept.join(found.select(row, merged.alias(cuts_name)), row, "left")
    text, cuts = F.col(text_col), F.col(cuts_name)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"])
    gaps = F.transform(cuts, lambda s, i: F.substring(text, (begin(i) + 1).cast("int"), (s["start"] - begin(i)).cast("int")))
    tail = F.substring(text, (F.element_at(cuts, -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(gaps, mark), F.lit(mark), tail))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(c) for c in columns])
