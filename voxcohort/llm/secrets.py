"""Secret scan with linking of the parts of a credential.

Base findings are assignments to secret-like names, access key ids and long hexadecimal runs. A credential
often has parts that prove little alone: a user name, a long mixed token, an endpoint. These weak parts are
found as candidates, and an interval join within a document (a range frame over the parts' positions, so
linear in the parts) asks which kinds stand within the scope of each:

- a weak identifier (kind user) is reported if a secret (assign, hex, key) is in scope,
- a weak secret (kind key) is reported if an identifier (access, user) is in scope,
- an endpoint (kind endpoint) is reported if both are.

Parts are in scope of each other if their starts are at most SCOPE code points apart. Weak parts that
overlap a base finding are not reported again. Only lengths and positions are kept, never the secrets.

A null text counts as empty and has no findings. Repeated rows are scanned each. An empty table gives an
empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.plans.storage import stored

SCOPE = 200
#: Fixed values of the base findings: pattern, the group whose length counts, its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
WEAK = {
    "user": (r"""((?i:access_?key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    "key": (r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", 0, 40),
    "endpoint": (r"(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|s3)://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", 0, 7),
}
KINDS = {**BASE, **WEAK}
RANK = {kind: i for i, kind in enumerate(KINDS)}
IDENTIFIERS, SECRETS = ("access", "user"), ("assign", "hex", "key")


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that no text with a finding fails."""
    has = lambda *words: F.lower(text).rlike("|".join(words))
    if kind == "assign":
        return has("passw", "secret", "token", "api_?key")
    if kind == "user":
        return has("access_?key", "client_?id", "user", "login", "account")
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    return text.rlike({"hex": "[0-9a-f]{32}", "key": "[A-Za-z0-9+/]{40}", "endpoint": r"://|[0-9]\.[0-9]"}[kind])


def _matches(kind: str, text: Column) -> Column:
    """An array of (kind, place, gap, n, m): the match's place, the code points before it since the last match, its length and its group's."""
    pattern, group, _ = KINDS[kind]
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(gaps.alias("g"), found.alias("f"), sizes.alias("s"))
    each = F.transform(zipped, lambda x, i: F.struct(F.lit(RANK[kind]).alias("kind"), i.alias("place"), F.length(x["g"]).alias("gap"), F.length(x["f"]).alias("n"), F.length(x["s"]).alias("m")))
    return F.when(_may_hold(kind, text), F.filter(each, lambda x: x["n"].isNotNull()))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, doc_id, found: one row per document with the matches of all kinds, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = "array<struct<kind:int,place:int,gap:int,n:int,m:int>>"
    none = F.array().cast(kind)
    found = F.concat(*(F.coalesce(_matches(k, text).cast(kind), none) for k in KINDS))
    return stored(docs.select(F.col(id_col).alias("doc_id"), found.alias("found")).withColumn("_row", F.monotonically_increasing_id()), "secret-parts")


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """_row, kind (its rank), start, end, base of the findings that are reported."""
    each = rows.select("_row", F.explode("found").alias("x")).select("_row", "x.*")
    upto = Window.partitionBy("_row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).withColumn("start", F.col("end") - F.col("n"))
    least = F.element_at(F.array(*(F.lit(v[2]) for v in KINDS.values())), F.col("kind") + 1)
    each = each.filter(F.col("m") >= least).select("_row", "kind", "start", "end", (F.col("kind") < len(BASE)).alias("base"))
    by_start = Window.partitionBy("_row").orderBy("start")
    near = by_start.rangeBetween(-scope, scope)
    one_of = lambda kinds: F.max(F.col("kind").isin([RANK[k] for k in kinds])).over(near)
    each = each.withColumn("_id", one_of(IDENTIFIERS)).withColumn("_secret", one_of(SECRETS))
    # Base spans that begin before or with a part and reach into it, and those that begin inside it.
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0)) > F.col("start")
    after = Window.partitionBy("_row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, -1)  # from the end, so that the frame only grows
    inside = F.min(F.when(F.col("base"), F.col("start"))).over(after) < F.col("end")
    each = each.withColumn("_again", F.coalesce(before, F.lit(False)) | F.coalesce(inside, F.lit(False)))
    kind = F.col("kind")
    co = F.when(kind == RANK["user"], F.col("_secret")).when(kind == RANK["key"], F.col("_id")).otherwise(F.col("_id") & F.col("_secret"))
    return each.filter(F.col("base") | (co & ~F.col("_again"))).select("_row", "kind", "start", "end", "base")


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, base; by start, then kind) of every row."""
    rows = parts(docs, id_col, text_col)
    spans = linked(rows.filter(F.size("found") > 0), scope)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("rank"), name.alias("kind"), "end", "base"))).alias("spans"))
    out = rows.select("doc_id", "_row").join(spans, "_row", "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

