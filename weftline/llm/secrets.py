"""Secret scans that link the parts of a credential, in DataFrame functions only.

A credential has parts: an identifier (who), a secret (the proof) and an endpoint (where). Strong parts are reported
wherever they stand: ``assign`` (a named secret with its value), ``access`` (an access key's id) and ``hex``. Weak ones prove
nothing alone: ``account`` (a named user or client), ``blob`` (a long token of mixed characters) and ``endpoint`` (an
address). A weak part is reported only if a complementary part stands within its scope: a secret beside an identifier or an
endpoint, an identifier or an endpoint beside a secret. A scope is a paragraph (what blank lines enclose), and there a
distance of at most ``reach`` code points. Weak parts that overlap a strong one are dropped, and blobs that overlap any other part.

How it scales: a text leaves its task only as slim rows, one a part, that are exchanged once by text. Places are running
sums of the lengths between matches. The interval join of parts is a sweep: sorted by place, each part meets the nearest part of each
role before and behind it, so work grows with the parts and not with their pairs.

Defined results: null and empty texts have no parts; texts of any length are scanned whole; rows equal in id and text each get
their row, ids may repeat or be null; parts that tie in start go by kind; an empty table gives no rows; other columns are not read,
so their names cannot clash; an id column called ``found`` raises.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import check_id


def any_case(regex: str) -> str:
    """The regex with every letter in either case."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", regex)


SAID = r"""["']?\x20*[:=]\x20*["']?"""
#: Kinds in the order of reports; the first three are strong.
PATTERNS = {
    "assign": f"({any_case('password|passwd|secret|token|api_?key')}){SAID}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "account": f"({any_case('user_?name|user_?id|user|login|account_?id|account|client_?id|key_?id')}){SAID}[A-Za-z0-9_.@-]{{3,}}",
    "blob": "[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": r"""(https?|ftps?|ssh|jdbc|amqps?|rediss?|mysql|postgres|postgresql|mongodb|s3)://[^\x00-\x20"'<>]+""",
}
KINDS = list(PATTERNS)
STRONG = 3
BREAK = r"\n[ \t\r]*\n"
IDENTIFIER, SECRET, ENDPOINT = ("access", "account"), ("assign", "hex", "blob"), ("endpoint",)


def _holds(kind: str, match: Column) -> Column:
    """What a match must have besides its form. The runs of access and hex are greedy, so their least length is in the form;
    an assignment with a short value still takes up its place."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, PATTERNS["assign"], 2)) >= 6
    if kind == "blob":
        return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.lit(True)


def _parts(text: Column, rank: int, kind: str, pattern: str) -> Column:
    """The matches of a kind in order: rank, code points since the last match of the kind, length, whether it holds."""
    part = lambda m, gap: F.struct(F.lit(rank).alias("rank"), F.length(gap).alias("gap"), F.length(m).alias("n"), _holds(kind, m).alias("holds"))
    zipped = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), part)
    none = F.array().cast("array<struct<rank:int,gap:int,n:int,holds:boolean>>")
    return F.when(text.rlike(pattern), F.filter(zipped, lambda p: p["n"].isNotNull())).otherwise(none)


def _of(kinds: tuple[str, ...]) -> Column:
    return F.col("rank").isin(*(KINDS.index(k) for k in kinds))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 300) -> DataFrame:
    """id and found: the reported parts (start, rank, end) by place, in code points; rank is a kind's place in ``KINDS``."""
    check_id(id_col, "found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text.alias("text"))
    parts = texts.select("id", "key", "text", F.concat(*(_parts(F.col("text"), i, k, p) for i, (k, p) in enumerate(PATTERNS.items()))).alias("parts"))
    # scopes matter where two parts can meet; each row has one head, which counts rows equal in id and text
    breaks = F.when(F.size("parts") > 1, _parts(F.col("text"), len(KINDS), "break", BREAK)).otherwise(F.slice("parts", 1, 0))
    head = F.array(F.struct(F.lit(-1).alias("rank"), F.lit(0).alias("gap"), F.lit(0).alias("n"), F.lit(False).alias("holds")))
    each = parts.select("id", "key", F.posexplode(F.concat(head, "parts", breaks)).alias("pos", "p")).select("id", "key", "pos", "p.*")
    once = each.repartition("id", "key").groupBy("id", "key", "pos", "rank", "gap", "n", "holds").agg(F.count(F.lit(1)).alias("copies"))
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("id", "key", "rank").orderBy("pos"))
    placed = once.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).where("holds or rank = -1")

    def nearest(by: list[str], last_end: dict[str, Column], next_start: dict[str, Column]) -> dict[str, Column]:
        """The largest end before and the smallest start behind a part, of the parts that a condition holds for."""
        ahead = Window.partitionBy(*by).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
        behind = Window.partitionBy(*by).orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
        return {n: F.max(F.when(c, F.col("end"))).over(ahead) for n, c in last_end.items()} | {n: F.min(F.when(c, F.col("start"))).over(behind) for n, c in next_start.items()}

    strong, named = F.col("rank").between(0, STRONG - 1), F.col("rank").between(0, len(KINDS) - 1) & (F.col("rank") != KINDS.index("blob"))
    scope = F.sum((F.col("rank") == len(KINDS)).cast("int")).over(Window.partitionBy("id", "key").orderBy("start", "rank"))
    seen = placed.withColumns(nearest(["id", "key"], {"s0": strong, "n0": named}, {"s1": strong, "n1": named}) | {"scope": scope})
    over = lambda last, following: F.coalesce(F.col(last) > F.col("start"), F.lit(False)) | F.coalesce(F.col(following) < F.col("end"), F.lit(False))
    free = F.when(F.col("rank") < STRONG, True).when(F.col("rank") == KINDS.index("blob"), ~over("n0", "n1")).otherwise(~over("s0", "s1"))
    apart = seen.where((F.col("rank") < len(KINDS)) & free).drop("s0", "n0", "s1", "n1")

    proof, other = _of(SECRET), _of(IDENTIFIER + ENDPOINT)
    met = apart.withColumns(nearest(["id", "key", "scope"], {"p0": proof, "o0": other}, {"p1": proof, "o1": other}))
    near = lambda last, following: F.coalesce(F.col("start") - F.col(last) <= reach, F.lit(False)) | F.coalesce(F.col(following) - F.col("end") <= reach, F.lit(False))
    linked = F.when(proof, near("o0", "o1")).otherwise(near("p0", "p1"))
    reported = (F.col("rank") >= 0) & ((F.col("rank") < STRONG) | linked)
    spans = F.array_sort(F.collect_list(F.when(reported, F.struct("start", "rank", "end"))))
    whole = met.groupBy("id", "key").agg(spans.alias("found"), F.max(F.when(F.col("rank") == -1, F.col("copies"))).alias("copies"))
    return whole.select(F.col("id").alias(id_col), "found", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_c")).drop("_c")


def told(spans: Column) -> Column:
    """kind:start:end of each part, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
