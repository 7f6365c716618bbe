"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Fixed patterns give the base spans (assignments, access keys, hexadecimal runs). Beyond them, long mixed tokens and keys
with a known prefix are candidates. Whether one is a live credential shows in who holds it: candidate values are hashed
and counted by distinct repositories and owners over the whole corpus. A value that many owners hold, or that is in many
repositories of more than one owner, is a copied example; any other looks live, and its spans are added. Base spans stay whatever their owners; their reach is reported.

A pattern's places are found by splitting: the pieces between matches and the matches alternate, so running sums of
their lengths are the offsets (in code points). Running sums go in two levels, so that a text with very many matches
stays near linear. No pattern looks ahead over a run, so a long text that repeats a prefix takes linear time as well.

Counting goes by (value, owner, repository) first and by value then, so that a value all documents hold is summed by
each task before it is exchanged.

Defined results: a null text counts as empty; no match gives an empty string of spans. A null owner or repository is an
owner of its own. Rows with equal id and text have equal results; repeated rows stay repeated. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import as_row, keep

# Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{32,}"  # runs are whole, so shorter ones simply fail
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGNED = 8
# Candidates of the method: tokens of 20 characters or more, and keys with a known prefix.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIXED = ("[0-9]", "[a-z]", "[A-Z]")  # tokens hold all three; keys with a known prefix need not
PREFIXES = (
    "[sprw]k_(?:live|test)_", "whsec_", "gh[opsur]_", "github_pat_", "glpat-", "xox[abeoprs]-", "xapp-", "AIza", "ya29[.]", "npm_", "pypi-", "hf_", "dop_v1_",
    "shp(?:at|ca|pa|ss)_", "SG[.]", "sk-", "ASIA",
)
KNOWN = f"(?<![A-Za-z0-9])(?:{'|'.join(PREFIXES)})[A-Za-z0-9_.-]{{8,}}(?<![.-])"
# No plain words: a digit behind the prefix. Asked of each match, as a look-ahead would be scanned again from every prefix.
NUMBERED = f"^(?:{'|'.join(PREFIXES)})[A-Za-z_.-]*[0-9]"
MANY_OWNERS = 3  # a value of so many owners is an example
MANY_REPOS = 5  # so is one in so many repositories of more than one owner; in those of one owner alone it is its own
BLOCK = 256
MASK = "[SECRET]"


def total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def with_spans(rows: DataFrame, kinds: dict[str, tuple[str, int]]) -> DataFrame:
    """Add per kind an array<struct<start, kind, end, value>> of its pattern's matches in ``text``, leftmost and
    non-overlapping. kinds: column -> pattern, number.

    Each step is a column of its own that later steps use at least twice, so that Spark computes it once per row and
    not again inside the lambda functions.
    """
    text, hit = F.col("text"), {c: F.col("text").rlike(pattern) for c, (pattern, _) in kinds.items()}
    ints, strings = F.array().cast("array<int>"), F.array().cast("array<string>")
    out = rows
    out = out.withColumns({f"{c}_found": F.when(hit[c], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(strings) for c, (p, _) in kinds.items()})
    out = out.withColumns({f"{c}_gaps": F.when(F.size(f"{c}_found") > 0, F.transform(F.split(text, p, -1), lambda x: F.char_length(x))).otherwise(ints) for c, (p, _) in kinds.items()})
    steps = lambda c: F.zip_with(f"{c}_found", F.slice(f"{c}_gaps", 1, F.size(f"{c}_found")), lambda m, g: g + F.char_length(m))
    out = out.withColumns({f"{c}_steps": steps(c) for c in kinds})

    def blocks(c):
        number = F.floor(F.size(f"{c}_steps") / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), number), lambda b: total(F.slice(f"{c}_steps", b * BLOCK + 1, BLOCK)))

    out = out.withColumns({f"{c}_blocks": blocks(c) for c in kinds})
    before = lambda c: F.transform(f"{c}_blocks", lambda _, b: total(F.slice(f"{c}_blocks", 1, b)))
    out = out.withColumns({f"{c}_before": before(c) for c in kinds})

    def starts(c):
        def start(_, i):
            block = F.floor(i / BLOCK).cast("int")
            return F.element_at(f"{c}_before", block + 1) + total(F.slice(f"{c}_steps", block * BLOCK + 1, i % BLOCK))

        return F.when(F.size(f"{c}_before") > 0, F.transform(f"{c}_steps", start))

    out = out.withColumns({f"{c}_starts": starts(c) for c in kinds})

    def spans(c, kind):
        pairs = F.zip_with(f"{c}_found", f"{c}_steps", lambda m, s: F.struct(m.alias("m"), s.alias("s")))
        return F.zip_with(f"{c}_starts", pairs, lambda at, x: F.struct(
            (at + x["s"] - F.char_length(x["m"])).alias("start"), F.lit(kind).alias("kind"), (at + x["s"]).alias("end"), x["m"].alias("value")
        ))

    return out.select(*rows.columns, *[spans(c, kind).alias(c) for c, (_, kind) in kinds.items()])


def spans_none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart(spans: str, others: str) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda c: ~F.exists(others, lambda b: overlap(b, c)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, doc (hash of the text), owner, repo, base (spans) and candidate (spans) of rows (doc_id, text, owner, repo)."""
    rows = docs.select("doc_id", "owner", "repo", F.xxhash64("text").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = with_spans(rows, {"assign": (ASSIGN, 0), "access": (ACCESS, 1), "hex": (HEX, 2), "mixed": (CANDIDATE, 3), "known": (KNOWN, 3)})
    assigned = F.transform("assign", lambda s: s.withField("value", F.regexp_extract(s["value"], ASSIGN, 2)))
    assigned = F.filter(assigned, lambda s: F.char_length(s["value"]) >= MIN_ASSIGNED)
    mixed = F.filter("mixed", lambda s: s["value"].rlike(MIXED[0]) & s["value"].rlike(MIXED[1]) & s["value"].rlike(MIXED[2]))
    known = F.filter("known", lambda s: s["value"].rlike(NUMBERED))
    based = found.select("doc_id", "owner", "repo", "doc", F.array_sort(F.concat(assigned, "access", "hex")).alias("base"), mixed.alias("mixed"), known.alias("known"))
    based = based.withColumn("mixed", apart("mixed", "base"))
    based = based.withColumn("known", apart("known", "base")).withColumn("known", apart("known", "mixed"))
    return based.select("doc_id", "owner", "repo", "doc", "base", F.concat("mixed", "known").alias("candidate"))


def reach(scanned: DataFrame) -> DataFrame:
    """value_hash, owners and repos of every base or candidate value of the corpus."""
    values = scanned.select("owner", "repo", F.explode(F.concat("base", "candidate")).alias("s"))
    values = values.select(F.sha2("s.value", 256).alias("value_hash"), "owner", "repo").groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
    whole = F.struct("owner", "repo")
    return values.groupBy("value_hash").agg(
        F.count_distinct(F.coalesce(F.xxhash64(F.struct(F.col("owner"), F.col("owner").isNull())), F.lit(0))).alias("owners"),
        F.count(whole).alias("repos"),
    )


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def owned_spans(scanned: DataFrame) -> DataFrame:
    """owned_id, owned_doc, owned (spans to add), n_live and n_example per document that holds any value."""
    held = scanned.select("doc_id", "doc", F.explode(F.concat("base", "candidate")).alias("s"))
    held = keep(held.select("doc_id", "doc", "s", F.sha2("s.value", 256).alias("value_hash")).distinct(), "held")
    judged = held.join(keep(reach(scanned), "reach"), "value_hash")
    example = (F.col("owners") >= MANY_OWNERS) | ((F.col("owners") > 1) & (F.col("repos") >= MANY_REPOS))
    live = ~example
    added = live & (F.col("s.kind") == F.lit(len(KINDS) - 1))
    return judged.groupBy(F.col("doc_id").alias("owned_id"), F.col("doc").alias("owned_doc")).agg(
        F.array_sort(F.collect_list(F.when(added, F.col("s")))).alias("owned"),  # the spans of one text
        F.sum(live.cast("long")).alias("n_live"),
        F.sum(example.cast("long")).alias("n_example"),
    )


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "source") -> DataFrame:
    """doc_id, base and spans (arrays), n_live and n_example of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(owner).alias("owner"), F.col(repo).alias("repo"))
    scanned = keep(scan(rows), "scanned")
    owned = keep(owned_spans(scanned), "owned")
    same = scanned["doc_id"].eqNullSafe(owned["owned_id"]) & (scanned["doc"] == owned["owned_doc"])
    return scanned.join(owned, same, "left").select(
        "doc_id", "base",
        F.array_sort(F.concat("base", F.coalesce("owned", spans_none()))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans as text."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(
        "doc_id", count(0), count(1), count(2),
        F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"), "n_live", "n_example",
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "source") -> DataFrame:
    """All rows and columns, with secret values in the text masked; a null text stays null."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(owner).alias("owner"), F.col(repo).alias("repo"))
    owned = owned_spans(keep(scan(rows), "scanned")).where(F.size("owned") > 0)
    owned = keep(owned.select("owned_id", "owned_doc", F.col("owned.value").alias("found")), "owned")
    own_id, own_text = F.col("row").getField(doc_id), F.col("row").getField(text)
    same = own_id.eqNullSafe(F.col("owned_id")) & (F.xxhash64(own_text) == F.col("owned_doc"))
    body = F.regexp_replace(own_text, ASSIGN.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]{%d,}" % MIN_ASSIGNED), f"$1={MASK}")
    for pattern in (ACCESS, HEX):
        body = F.regexp_replace(body, pattern, MASK)
    # longer values first: a shorter one may be a part of them
    found = F.transform(F.array_sort(F.transform("found", lambda v: F.struct((-F.char_length(v)).alias("size"), v.alias("v")))), lambda s: s["v"])
    masked = F.aggregate(F.coalesce(found, F.array().cast("array<string>")), body, lambda t, v: F.replace(t, v, F.lit(MASK)))
    columns = [masked.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return as_row(docs).join(owned, same, "left").select(*columns)
