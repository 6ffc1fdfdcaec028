"""Column helpers: identifiers, keys, ranges, checked arithmetic, lifecycle predicates. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\A\p{IsWhite_Space}*\z"
CONTROL = r"\p{Cc}"
HASH = r"\A[0-9a-f]{64}\z"
#: Fixed values of the data model.
MAX_KEY_BYTES = 4096
MAX_FILE_ID_BYTES = 1024
MAX_SCOPE_BYTES = 512
FUTURE_SKEW_SECONDS = 300
CLAIM_RETENTION_SECONDS = 2_592_000
DELETION_HOLD_SECONDS = 86_400
MAX_TAG = 128


# -- hashes and hex


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def from_hex(text: Column) -> Column:
    return F.unhex(text)


def group_reversed_hex(text: Column, group: int = 8) -> Column:
    """Hex of the same bytes with each group of ``group`` bytes reversed; its own inverse."""
    n = F.length(text)
    pair = lambda g, i: F.substring(text, (g * group + (group - 1 - i)) * 2 + 1, F.lit(2))
    groups = F.sequence(F.lit(0), F.floor(n / (2 * group)).cast("int") - 1)
    return F.array_join(F.transform(groups, lambda g: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(group - 1)), lambda i: pair(g, i)), "")), "")


def little_endian_hex(x: Column) -> Column:
    """The eight bytes of a non-negative long, least significant first, as 16 hex digits."""
    h = F.lpad(F.lower(F.hex(x.cast("long"))), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])


def digest_of_text_id(digest: Column) -> Column:
    """The 64 hex digits of a sha256:... digest, null if malformed."""
    found = F.regexp_extract(digest, r"\Asha256:([0-9a-f]{64})\z", 1)
    return F.when(found != "", found)


def stable_hex_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


# -- length-prefixed keys


def lp(x: Column) -> Column:
    """Collision-free component: byte length, colon, text."""
    return F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)


def scope_key(provider: Column, owner: Column, name: Column, revision: Column) -> Column:
    """Null provider: the global scope."""
    own = F.concat(lp(provider), lp(owner), lp(name), F.coalesce(lp(revision), F.lit("")))
    return F.when(provider.isNull(), lp(F.lit("global"))).otherwise(own)


def record_key(kind: Column, scope: Column, file_id: Column, content_hash: Column | None = None) -> Column:
    """A latest key has no content hash; a version key ends with it."""
    base = F.concat(lp(kind), lp(scope), lp(file_id))
    return base if content_hash is None else F.concat(base, F.coalesce(lp(content_hash), F.lit("")))


def scope_namespace(provider: Column, owner: Column, name: Column, revision: Column) -> Column:
    nul = F.lit("\0")
    own = F.sha2(F.concat(provider, nul, owner, nul, name, nul, F.coalesce(revision, F.lit(""))).cast("binary"), 256)
    return F.when(provider.isNull(), F.lit("global")).otherwise(own)


def identity_key(provider: Column, owner: Column, name: Column, revision: Column, file_id: Column, content_hash: Column) -> Column:
    repo = F.concat(provider, F.lit(":"), owner, F.lit("/"), name, F.lit("@"), F.coalesce(revision, F.lit("latest")))
    return F.concat(F.coalesce(repo, F.lit("unscoped")), F.lit(":"), file_id, F.lit(":"), content_hash)


# -- object keys


def chunk_key(hash: Column) -> Column:
    return F.concat(F.substring(hash, 1, 2), F.lit("/"), hash)


def xorb_key(hash: Column) -> Column:
    return F.concat(F.lit("xorbs/default/"), F.substring(hash, 1, 2), F.lit("/"), hash, F.lit(".xorb"))


def shard_key(hash: Column) -> Column:
    return F.concat(F.lit("shards/"), F.substring(hash, 1, 2), F.lit("/"), hash, F.lit(".shard"))


def lfs_key(namespace: Column, oid: Column) -> Column:
    return F.concat(F.lit("protocols/lfs/"), namespace, F.lit("/objects/"), oid)


def bazel_key(namespace: Column, kind: Column, hash: Column) -> Column:
    """kind: ac or cas."""
    return F.concat(F.lit("protocols/bazel/"), namespace, F.lit("/"), kind, F.lit("/"), hash)


def oci_key(namespace: Column, repository: Column, kind: str, *rest: Column) -> Column:
    """kind: blobs, manifests, manifest-media-types, tags or tag-targets; rest: digest or tag, or both."""
    return F.concat_ws("/", F.lit("protocols/oci"), namespace, F.lit("repos"), stable_hex_id(repository), F.lit(kind), *rest)


def classify_key(key: Column) -> Column:
    """struct(class, hash, error): chunk, xorb, shard or unmanaged. A key of a managed shape whose two-digit part starts its name
    but whose name is no hash is an error, not unmanaged."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(key, pattern, group)

    shapes = {
        "chunk": r"\A([0-9a-fA-F]{2})/(\1[^/]*)\z",
        "xorb": r"\Axorbs/default/([0-9a-fA-F]{2})/(\1[^/]*)\.xorb\z",
        "shard": r"\Ashards/([0-9a-fA-F]{2})/(\1[^/]*)\.shard\z",
    }
    kind, hash, error = F.lit("unmanaged"), F.lit(None).cast("string"), F.lit(False)
    for name, pattern in shapes.items():
        found = part(pattern, 2)
        kind = F.when(found.rlike(HASH), F.lit(name)).otherwise(kind)
        hash = F.when(found.rlike(HASH), found).otherwise(hash)
        error = error | ((found != "") & ~found.rlike(HASH))
    return F.struct(kind.alias("class"), hash.alias("hash"), error.alias("error"))


# -- validators


def valid_hash(x: Column) -> Column:
    return F.coalesce(x.rlike(HASH), F.lit(False))


def valid_file_id(x: Column) -> Column:
    ok = ~x.rlike(BLANK) & (x != ".") & (F.octet_length(x) <= MAX_FILE_ID_BYTES) & ~x.contains("..") & ~x.contains("\\") & ~x.contains("/") & ~x.rlike(CONTROL)
    return F.coalesce(ok, F.lit(False))


def valid_object_key(x: Column) -> Column:
    parts = F.split(x, "/")
    bad = F.exists(parts, lambda p: (p == "") | (p == ".") | (p == ".."))
    return F.coalesce((x != "") & (F.octet_length(x) <= MAX_KEY_BYTES) & ~x.contains("\\") & ~x.rlike(CONTROL) & ~bad, F.lit(False))


def valid_scope_part(x: Column) -> Column:
    return F.coalesce(~x.rlike(BLANK) & (F.octet_length(x) <= MAX_SCOPE_BYTES) & ~x.rlike(CONTROL), F.lit(False))


def valid_repository_name(x: Column) -> Column:
    """Segments of lower-case letters, digits, dot, underscore and hyphen; none empty, dot or dot-dot."""
    return F.coalesce(x.rlike(r"\A[a-z0-9._-]+(/[a-z0-9._-]+)*\z") & ~F.exists(F.split(x, "/"), lambda p: (p == ".") | (p == "..")), F.lit(False))


def repository_in_scope(x: Column, owner: Column, name: Column) -> Column:
    """The scope's own repository or one below it; no scope, any."""
    root = F.concat(F.lower(owner), F.lit("/"), F.lower(name))
    return F.coalesce((x == root) | F.startswith(x, F.concat(root, F.lit("/"))), F.lit(True))


def valid_tag(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\A[A-Za-z0-9_][A-Za-z0-9._-]{0,127}\z"), F.lit(False))


def valid_upload_id(x: Column, most: int = 128) -> Column:
    return F.coalesce(x.rlike(r"\A[0-9a-fA-F-]+\z") & (F.octet_length(x) <= most), F.lit(False))


def scope_allows(scope: Column, need: str) -> Column:
    return scope.isin("write", "read") if need == "read" else scope == "write"


def same_scope(left: str, right: str) -> Column:
    """Exact equality of two scope structs, revision included; two global scopes are equal."""
    return F.col(left).eqNullSafe(F.col(right))


def same_repository(left: str, right: str) -> Column:
    return (F.col(f"{left}.provider") == F.col(f"{right}.provider")) & (F.col(f"{left}.owner") == F.col(f"{right}.owner")) & (F.col(f"{left}.name") == F.col(f"{right}.name"))


# -- lifecycle predicates


def hold_active(release_after: Column, now: int) -> Column:
    return release_after.isNull() | (release_after > now)


def hold_expired(held_at: Column, release_after: Column, now: int) -> Column:
    return F.coalesce((release_after < held_at) | (release_after <= now), F.lit(False))


def hold_release(held_at: Column, ttl: Column) -> Column:
    """No time to live, no release."""
    return held_at + ttl


def quarantine_due(delete_after: Column, now: int) -> Column:
    return delete_after <= now


def future(ts: Column, now: int) -> Column:
    return F.coalesce(ts > now + FUTURE_SKEW_SECONDS, F.lit(False))


def stale(ts: Column, now: int, retention: int) -> Column:
    return F.coalesce(ts <= max(0, now - retention), F.lit(False))


def token_expired(expires: Column, now: int) -> Column:
    return expires < now


def cache_live(expires_at: Column, now: int) -> Column:
    return expires_at > now


def quarantine_class(present: Column, reachable: Column, held: Column) -> Column:
    """Repair classes of a quarantine candidate; the first that holds."""
    return F.when(~present, F.lit("delete_missing")).when(reachable, F.lit("delete_reachable")).when(held, F.lit("delete_held")).otherwise(F.lit("keep"))


def hold_class(present: Column, expired: Column) -> Column:
    return F.when(expired, F.lit("delete_expired")).when(~present, F.lit("delete_missing")).otherwise(F.lit("keep"))


def delivery_class(processed_at: Column, now: int, retention: int = CLAIM_RETENTION_SECONDS) -> Column:
    return F.when(future(processed_at, now), F.lit("delete_future")).when(stale(processed_at, now, retention), F.lit("delete_stale")).otherwise(F.lit("keep"))


def latest_signal(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def reconciled_at(signal: Column, reconciled: Column, now: int) -> Column:
    return F.when(signal.isNull() | F.coalesce(reconciled >= signal, F.lit(False)), reconciled).otherwise(F.lit(now).cast("long"))


# -- ranges and arithmetic


def range_length(start: Column, end_inclusive: Column) -> Column:
    """Null on overflow."""
    return F.try_add(end_inclusive - start, F.lit(1).cast("long"))


def checked_add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


#: Counters, rates and range bounds are unsigned 64-bit numbers.
MAX_BOUND = (1 << 64) - 1


def saturating_mul(a: Column, by: int) -> Column:
    """A product that stops at the largest unsigned 64-bit number."""
    return F.least(a.cast("decimal(20,0)") * F.lit(by), F.lit(str(MAX_BOUND)).cast("decimal(38,0)"))


def whole(a: Column, b: Column) -> Column:
    """Whole-number quotient."""
    return F.call_function("div", a, b)


def throughput(bytes: Column, micros: Column) -> Column:
    """Bytes a second; the product saturates, and no time is no rate."""
    return F.when(micros <= 0, F.lit(0).cast("long")).otherwise(whole(saturating_mul(bytes, 1_000_000), micros))


def scaling_per_mille(aggregate: Column, single: Column, concurrency: Column) -> Column:
    """What a thousandth of the ideal speed-up a concurrent run reaches; 0 if any of the three is."""
    some = (aggregate > 0) & (single > 0) & (concurrency > 0)
    return F.when(some, whole(whole(saturating_mul(aggregate, 1000), single), concurrency)).otherwise(F.lit(0).cast("long"))


def per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.expr("0L") + F.floor(part.cast("decimal(38,0)") * 1000 / whole).cast("long"))


def transfer_permits(bytes: Column, chunk: int, most: int) -> Column:
    return F.least(F.ceil(F.greatest(bytes, F.lit(1)) / chunk), F.lit(most)).cast("long")


def adaptive_default(cores: Column, factor: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), cores * factor))


def http_range(header: Column, length: Column) -> Column:
    """struct(start, end, error) of a bytes=a-b header against a length: one range, open end, end clamped to the last byte.

    Errors, the first that holds: unit (no bytes= before it, or null), syntax (no hyphen, several ranges, no start), number (a bound that is
    no unsigned 64-bit number), unsatisfiable (the start is past the last byte), syntax again (the end is before the start).
    """
    rest = F.substring(header, 7, 1 << 20)
    at = F.instr(rest, "-")
    first, last = F.when(at > 0, F.substring(rest, F.lit(1), at - 1)), F.substring(rest, at + 1, F.lit(1 << 20))
    number = lambda x: F.when(x.rlike(r"\A\+?0*\d{1,20}\z"), x.try_cast("decimal(38,0)"))
    bound = lambda x: F.when(number(x) <= F.lit(str(MAX_BOUND)).cast("decimal(38,0)"), number(x))
    start, top = bound(first), (length - 1).cast("decimal(38,0)")
    end = F.when(last == "", top).otherwise(bound(last))
    error = (
        F.when(~F.coalesce(header.startswith("bytes="), F.lit(False)), F.lit("unit"))
        .when((at == 0) | rest.contains(",") | F.coalesce(first == "", F.lit(False)), F.lit("syntax"))
        .when(start.isNull(), F.lit("number"))
        .when(start > top, F.lit("unsatisfiable"))
        .when(end.isNull(), F.lit("number"))
        .when(end < start, F.lit("syntax"))
    )
    ok = error.isNull()
    return F.struct(F.when(ok, start).cast("long").alias("start"), F.when(ok, F.least(end, top)).cast("long").alias("end"), error.alias("error"))


def content_range(header: Column) -> Column:
    """struct(start, end) of an upload's range; nulls if malformed. An optional unit before and a total after it are ignored."""
    m = r"\A\s*(?:bytes )?(\d{1,18})-(\d{1,18})\s*(?:/.*)?\z"
    a, b = F.regexp_extract(header, m, 1).try_cast("long"), F.regexp_extract(header, m, 2).try_cast("long")
    return F.struct(F.when(a <= b, a).alias("start"), F.when(a <= b, b).alias("end"))


def transfer_url(base: Column, path: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), path)


# -- provider payloads


def json_text(payload: Column, *paths: str) -> Column:
    """The first of the paths that holds a string; numbers and objects do not count."""
    value = F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), p, "variant")) == "STRING", F.try_variant_get(F.try_parse_json(payload), p, "string")) for p in paths])
    return value


def owner_and_name(full_name: Column) -> Column:
    parts = F.split(full_name, "/", 2)
    ok = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.struct(F.when(ok, F.get(parts, F.lit(0))).alias("owner"), F.when(ok, F.get(parts, F.lit(1))).alias("name"))


def visibility(private: Column) -> Column:
    return F.when(private, F.lit("private")).otherwise(F.lit("public"))


def branch_of(ref: Column) -> Column:
    return F.regexp_replace(ref, r"\Arefs/(heads|tags)/", "")
