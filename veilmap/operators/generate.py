"""Deterministic fake values for distinct identifiers.

Order comes from a salted hash of the original and numbers from dense ranks, so the same
identifiers always get the same fakes, and no two identifiers share one.  Values that are
already a fake, or that occur as an original, are never handed out.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmap.functions.hashing import hex_number, salted_md5, uuid5_url
from veilmap.functions.pools import ACCOUNT_STEMS, FAKE_DOMAINS, HOST_WORDS
from veilmap.operators.numbering import free_slots, ordinal
from veilmap.schemas import IDENTIFIER_TYPES, MAP_COLUMNS
from veilmap.sources.storage import materialize

# Network addresses 10.B.C.D, 172.(16..31).C.D and 192.168.C.D laid out one after another.
_TEN, _SEVENTEEN = 256 * 254 * 254, 16 * 256 * 254
_ANY_PRIVATE = _TEN + _SEVENTEEN + 256 * 254
_PER_PREFIX = 254 * 254
_PER_OUI = 1 << 24
# Up to this many rows one window per group is as good as bucketed ranks.
_FEW_ROWS = 1_000_000
_SALTS = 16
# Odd and coprime to the layouts above, so multiplication permutes the slots.
_STRIDE = 7_368_787
_SID_NUMBERS = 3_294_967_296
# Redraws before giving up.
_TURNS = 40
_NUMBER = r"([0-9]{1,15})"


def _pick(pool, index: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(pool)), " "), index.cast("int"))


def _hex(start: int, length: int, column: str = "h") -> Column:
    return hex_number(F.substring(F.col(column), start, length))


def malformed(identifier_type: Column, value: Column) -> Column:
    """Why no fake can be generated, null if one can."""
    shapes = {
        "ipv4": r"^[^.]*(\.[^.]*){3}$",
        "cidr": r"^[^./]*(\.[^./]*){3}/[^/]*$",
        "upn": r"^[^@]*@[^@]*$",
        "sid": r"^S-1-5-21-",
        "mac": r"^[^:-]*([:-][^:-]*){5}$",
        "unc": r"^\\\\[^\\]*\\",
    }
    reason = F.when(~F.coalesce(identifier_type.isin(*IDENTIFIER_TYPES), F.lit(False)),
                    F.lit("unknown identifier type")).when(value.isNull(), F.lit("missing value"))
    for kind, shape in shapes.items():
        reason = reason.when((identifier_type == kind) & ~F.rlike(value, F.lit(shape)),
                             F.lit(f"invalid {kind}"))
    return reason


def malformed_identifiers(identifiers: DataFrame) -> DataFrame:
    """(identifier_type, value, reason): the identifiers for which no fake can be generated."""
    reason = malformed(F.col("identifier_type"), F.col("value"))
    return identifiers.select("identifier_type", "value", reason.alias("reason")).where("reason is not null")


def _padded(number: Column, width) -> Column:
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.call_function("lpad", digits, width, F.lit("0"))
                  ).otherwise(digits)


def _numbered(requests: DataFrame, names: DataFrame, group: str, pattern: str,
              small: bool) -> DataFrame:
    """Adds `number`, dense per group, above every number `pattern` (group name, number)
    finds in `names.name`."""
    floors = (names.select(F.regexp_extract("name", pattern, 1).alias(group),
                           F.regexp_extract("name", pattern, 2).alias("_n"))
              .where("_n <> ''").groupBy(group)
              .agg(F.max(F.col("_n").try_cast("bigint")).alias("_floor")))
    ranked = ordinal(requests, [group], F.substring("h", 1, 4),
                     [F.col("h"), F.col("original_value")], small=small)
    # At most one row per word of a fixed list, so the join never shuffles the requests.
    known = floors.where(F.array_contains(
        F.split(F.lit(" ".join(HOST_WORDS + ACCOUNT_STEMS)), " "), F.col(group)))
    return ranked.join(F.broadcast(known), group, "left").withColumn(
        "number", F.col("ordinal") + F.coalesce("_floor", F.lit(0))).drop("_floor", "ordinal")


def host_labels(requests: DataFrame, names: DataFrame, small: bool = False) -> DataFrame:
    """Adds `label`, SRV-{WORD}-{NN}, unique among the requests and unused in `names`."""
    words = "|".join(HOST_WORDS)
    named = requests.withColumn("word", _pick(HOST_WORDS, _hex(1, 2) % len(HOST_WORDS)))
    numbered = _numbered(named, names, "word", rf"^(?:\\\\)?SRV-({words})-{_NUMBER}(?![0-9])",
                         small)
    return numbered.withColumn("label", F.concat(
        F.lit("SRV-"), F.col("word"), F.lit("-"), _padded(F.col("number"), F.lit(2)))
    ).drop("word", "number")


def _masked_domain(domain: Column) -> Column:
    """Another organisation under the same top-level label."""
    stand_in = F.when(F.startswith(F.lower(domain), F.lit("fabrikam.")), F.lit("contoso.")).otherwise(
        F.lit("fabrikam."))
    return F.concat(stand_in, F.substring_index(domain, ".", -1))


def _host_name(label: Column, original: Column, suffix: str, preserve_format: bool) -> Column:
    """The label, plus for dotted originals the rest kept (`keep`) or replaced (`mask`)."""
    if not preserve_format:
        return label
    rest = F.substring(original, F.instr(original, ".") + 1, F.length(original))
    dotted = F.contains(original, F.lit("."))
    if suffix == "keep":
        return F.when(dotted, F.concat(label, F.lit("."), rest)).otherwise(label)
    named = F.rlike(rest, F.lit(r"[A-Za-z]+$"))
    return F.when(dotted & named, F.concat(label, F.lit("."), _masked_domain(rest))).otherwise(label)


def fake_hostname(requests, names, suffix="mask", preserve_format=True, small=False) -> DataFrame:
    return host_labels(requests, names, small).withColumn("anonymized_value", _host_name(
        F.col("label"), F.col("original_value"), suffix, preserve_format))


def fake_upn(requests, names, upn_domain="mask", preserve_format=True, small=False) -> DataFrame:
    stems = "|".join(ACCOUNT_STEMS)
    named = requests.withColumn("stem", _pick(ACCOUNT_STEMS, _hex(5, 2) % len(ACCOUNT_STEMS)))
    numbered = _numbered(named, names, "stem", rf"^({stems}){_NUMBER}@", small)
    domain = F.substring_index("original_value", "@", -1)
    listed = _pick(FAKE_DOMAINS, _hex(7, 4) % len(FAKE_DOMAINS))
    if not preserve_format:
        fake = listed
    else:
        named_like = _masked_domain(domain) if upn_domain == "mask" else F.concat(
            F.lit("fabrikam."), F.split_part(domain, F.lit("."), F.lit(2)))
        fake = F.when(F.contains(domain, F.lit(".")), named_like).otherwise(listed)
    width = F.when(F.col("stem") == "user", 3).otherwise(2)
    return numbered.withColumn("anonymized_value", F.concat(
        "stem", _padded(F.col("number"), width), F.lit("@"), fake))


# -- addresses ---------------------------------------------------------------------

def _any_private(position: Column) -> Column:
    """Address at a position of the whole private layout."""
    dotted = lambda *octets: F.concat_ws(".", *[o.cast("string") for o in octets])
    p, q, r = position, position - _TEN, position - _TEN - _SEVENTEEN
    div = lambda a, b: F.floor(a / F.lit(b)).cast("int")
    return (F.when(p < _TEN, dotted(F.lit(10), div(p, _PER_PREFIX), div(p % _PER_PREFIX, 254) + 1,
                                    p % 254 + 1))
            .when(q < _SEVENTEEN, dotted(F.lit(172), div(q, 256 * 254) + 16,
                                         div(q % (256 * 254), 254), q % 254 + 1))
            .otherwise(dotted(F.lit(192), F.lit(168), div(r, 254), r % 254 + 1)))


def _octets(names: DataFrame, pattern: str) -> DataFrame:
    found = names.select(*[F.regexp_extract("name", pattern, i).alias(f"o{i}") for i in range(1, 6)])
    return found.where("o1 <> ''").select(
        *[F.col(f"o{i}").try_cast("bigint").alias(f"o{i}") for i in range(1, 5)], F.col("o5").alias("mask"))


_PLAIN_ADDRESS = r"^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.([1-9][0-9]{0,2})(?:/([0-9]{1,2}))?$"


def _allocate(requests: DataFrame, taken: DataFrame, group, small: bool = False) -> DataFrame:
    ranked = ordinal(requests, group, F.substring("h", 1, 3),
                     [F.col("h"), F.col("original_value")], small=small)
    return free_slots(ranked, taken, group, small=small)


def fake_address(requests: DataFrame, names: DataFrame, preserve_format: bool = True,
                 rows: int | None = None) -> DataFrame:
    """ipv4 and cidr: first two octets and /prefix kept, the last two in 1..254.

    Where a /16 has no address left, the remaining identifiers get any free private one.
    `rows`, if known, bounds requests and names together: too few cannot fill a /16.
    """
    small = rows is not None and rows <= _FEW_ROWS
    asked = requests.withColumns({
        "mask": F.when(F.contains("original_value", F.lit("/")),
                       F.substring_index("original_value", "/", -1)).otherwise(""),
        "prefix": F.substring_index("original_value", ".", 2)})
    used = _octets(names, _PLAIN_ADDRESS)

    def anywhere(rows: DataFrame, also_used: DataFrame | None) -> DataFrame:
        spots = used if also_used is None else used.unionByName(also_used)
        o2, o3, o4 = F.col("o2"), F.col("o3"), F.col("o4")
        at = (F.when((F.col("o1") == 10) & o3.between(1, 254), o2 * _PER_PREFIX + (o3 - 1) * 254 + o4 - 1)
              .when((F.col("o1") == 172) & o2.between(16, 31),
                    (o2 - 16) * 256 * 254 + o3 * 254 + o4 - 1 + _TEN)
              .when((F.col("o1") == 192) & (o2 == 168), o3 * 254 + o4 - 1 + _TEN + _SEVENTEEN))
        back = pow(_STRIDE, -1, _ANY_PRIVATE)
        taken = spots.where((o2 < 256) & (o3 < 256) & (o4 < 255) & at.isNotNull()).select(
            "mask", (at * back % _ANY_PRIVATE).alias("slot"))
        spot = F.col("slot") * _STRIDE % _ANY_PRIVATE
        full = F.when(F.col("slot") >= _ANY_PRIVATE, F.raise_error(F.lit("no private address left")))
        return _allocate(rows, taken, ["mask"], small).withColumn(
            "_ip", F.coalesce(full.cast("string"), _any_private(spot)))

    if not preserve_format:
        placed = anywhere(asked, None)
    else:
        kept = used.where(F.col("o3").between(1, 254) & F.col("o4").between(1, 254)).select(
            F.concat_ws(".", F.col("o1"), F.col("o2")).alias("prefix"), "mask",
            ((F.col("o3") - 1) * 254 + F.col("o4") - 1).alias("slot"))
        slots = _allocate(asked, kept, ["prefix", "mask"], small)
        may_overflow = rows is None or rows >= _PER_PREFIX
        if may_overflow:
            slots = materialize(slots, "addresses")
        placed = slots.where(F.col("slot") < _PER_PREFIX).withColumn("_ip", F.concat_ws(
            ".", F.col("prefix"), F.floor(F.col("slot") / 254) + 1, F.col("slot") % 254 + 1))
        rest = slots.where(F.col("slot") >= _PER_PREFIX)
        if may_overflow and not rest.isEmpty():
            given = placed.select(F.concat("_ip", F.when(F.col("mask") != "", F.concat(
                F.lit("/"), "mask")).otherwise("")).alias("name"))
            placed = placed.unionByName(anywhere(
                rest.drop("slot"), _octets(given, _PLAIN_ADDRESS)), allowMissingColumns=True)
    return placed.withColumn("anonymized_value", F.concat(
        "_ip", F.when(F.col("mask") != "", F.concat(F.lit("/"), "mask")).otherwise("")))


def fake_mac(requests: DataFrame, names: DataFrame, preserve_format: bool = True,
             rows: int | None = None) -> DataFrame:
    """First three octets kept (lower case with colons, as they are with hyphens), the last
    three new; a mixed address counts as one with colons.  Without `preserve_format` all six are
    new.  `rows` as in `fake_address`."""
    small = rows is not None and rows <= _FEW_ROWS
    original = F.col("original_value")
    mark = F.when(F.contains(original, F.lit(":")), F.lit(":")).otherwise(F.lit("-"))
    octets = F.split(F.replace(original, F.lit("-"), F.lit(":")), ":", -1)
    oui = F.array_join(F.slice(octets, 1, 3), ":")
    asked = requests.withColumns({
        "mark": mark, "oui": F.when(mark == ":", F.lower(oui)).otherwise(F.replace(oui, F.lit(":"), F.lit("-")))})

    def drawn(rows: DataFrame, turn: int = 0) -> DataFrame:
        h = F.col("h") if not turn else F.sha2(F.concat("h", F.lit(f"/{turn}")), 256)
        return rows.withColumn("_d", h).withColumn("oui", F.concat(
            F.substring("_d", 1, 2), "mark", F.substring("_d", 3, 2), "mark", F.substring("_d", 5, 2))).drop("_d")

    if not preserve_format:
        asked = drawn(asked)
    # Addresses that differ only in case or delimiter count as the same device here.
    shape = r"^([0-9a-f]{2})[:-]([0-9a-f]{2})[:-]([0-9a-f]{2})[:-]([0-9a-f]{2})[:-]([0-9a-f]{2})[:-]([0-9a-f]{2})$"
    parts = names.select(*[F.regexp_extract(F.lower("name"), shape, i).alias(f"o{i}") for i in range(1, 7)])
    back = pow(_STRIDE, -1, _PER_OUI)
    taken = parts.where("o1 <> ''").select(
        F.concat("o1", "o2", "o3").alias("device"),
        (hex_number(F.concat("o4", "o5", "o6")) * back % _PER_OUI).alias("slot"))
    device = F.regexp_replace(F.lower("oui"), "[:-]", "")

    def place(rows: DataFrame, used: DataFrame) -> DataFrame:
        slots = _allocate(rows.withColumn("device", device), used, ["device"], small)
        tail = F.lpad(F.lower(F.hex(F.col("slot") * _STRIDE % _PER_OUI)), 6, "0")
        return slots.withColumn("anonymized_value", F.concat(
            "oui", "mark", F.substring(tail, 1, 2), "mark", F.substring(tail, 3, 2), "mark",
            F.substring(tail, 5, 2)))

    placed = place(asked, taken)
    if rows is not None and rows < _PER_OUI:
        return placed
    done = None
    for turn in range(_TURNS):
        placed = materialize(placed, "macs")
        good = placed.where(F.col("slot") < _PER_OUI)
        done = good if done is None else done.unionByName(good)
        full = placed.where(F.col("slot") >= _PER_OUI)
        if full.isEmpty():
            return done
        # An exhausted vendor prefix: the rest draw theirs from the hash, beside all given so far.
        taken = taken.unionByName(good.select("device", "slot"))
        placed = place(drawn(full.select(asked.columns), turn + 1), taken)
    raise ValueError("no free MAC addresses found")


def fake_guid(requests: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The version 5 UUID of the original; where that is one of `names`, of the original and a turn."""
    if names is None:
        return requests.withColumn("anonymized_value", uuid5_url(F.col("original_value")))
    used = names.select(F.col("name").alias("anonymized_value"), F.lit(True).alias("_used")).distinct()
    rest, done = requests, None
    for turn in range(_TURNS):
        seed = F.col("original_value") if not turn else F.concat("original_value", F.lit(f"/{turn}"))
        told = materialize(rest.withColumn("anonymized_value", uuid5_url(seed)).join(used, "anonymized_value", "left"), "guids")
        good = told.where("_used is null").select(*requests.columns, "anonymized_value")
        done = good if done is None else done.unionByName(good)
        rest = told.where("_used").select(requests.columns)
        if rest.isEmpty():
            return done
    raise ValueError("no free GUIDs found")


def fake_sid(requests: DataFrame, names: DataFrame) -> DataFrame:
    """S-1-5-21 and as many sub-authorities as before, each 1000000000..4294967295; none that is
    given already or occurs in `names`."""
    count = F.size(F.split("original_value", "-", -1)) - 4

    def value(seed: Column) -> Column:
        return F.concat(F.lit("S-1-5-21-"), F.array_join(F.transform(
            F.sequence(F.lit(1), count), lambda i: (hex_number(F.substring(F.sha2(F.concat(
                seed, F.lit("-"), i.cast("string")), 256), 1, 13)) % _SID_NUMBERS
                + 1_000_000_000).cast("string")), "-"))

    rest, done, used = requests, None, names.where(F.startswith("name", F.lit("S-1-5-21-"))).select("name").distinct()
    for turn in range(_TURNS):
        seed = F.col("h") if not turn else F.concat("h", F.lit(f"/{turn}"))
        drawn = rest.withColumn("anonymized_value", value(seed))
        first = drawn.groupBy("anonymized_value").agg(F.min("original_value").alias("_first"))
        told = drawn.join(first, "anonymized_value").join(
            used.select(F.col("name").alias("anonymized_value"), F.lit(True).alias("_used")), "anonymized_value", "left")
        told = materialize(told.withColumn(
            "_good", F.col("_used").isNull() & (F.col("_first") == F.col("original_value"))), "sids")
        good = told.where("_good").select(*requests.columns, "anonymized_value")
        done = good if done is None else done.unionByName(good)
        rest = told.where("not _good").select(requests.columns)
        if rest.isEmpty():
            return done
        used = used.unionByName(good.select(F.col("anonymized_value").alias("name")))
    raise ValueError("no free SIDs found")


# -- UNC paths ---------------------------------------------------------------------

def _unc_parts(requests: DataFrame) -> DataFrame:
    parts = F.split(F.substring("original_value", 3, 2**31 - 1), r"\\", -1)
    return requests.withColumns({
        "server": F.get(parts, F.lit(0)), "share": F.get(parts, F.lit(1)),
        "tail": F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))})


def _unc_path(server: Column, share: Column, tail: str) -> Column:
    rest = F.col("tail") if tail == "keep" else F.transform(
        "tail", lambda s: F.concat(F.lit("Dir"), F.substring(F.md5(F.concat("h", s).cast("binary")), 1, 12)))
    return F.concat(F.lit("\\\\"), F.array_join(F.concat(F.array(server, share), rest), "\\"))


def _hidden(share: Column) -> Column:
    return F.when(F.endswith(share, F.lit("$")), F.lit("$")).otherwise(F.lit(""))


def fake_unc_alone(labelled: DataFrame, suffix="mask", tail="keep", preserve_format=True) -> DataFrame:
    """Every path has a server label of its own, so any share number is unambiguous."""
    rows = _unc_parts(labelled)
    server = _host_name(F.col("label"), F.col("server"), suffix, preserve_format)
    numbered = F.concat(F.lit("Share"), (_hex(9, 4) % 99 + 1).cast("string"), _hidden(F.col("share")))
    share = F.when(F.col("share") == "", "").otherwise(numbered) if preserve_format else F.col("share")
    return rows.withColumn("anonymized_value", _unc_path(server, share, tail))


def fake_unc_linked(requests: DataFrame, servers: DataFrame, salt: str, tail="keep",
                    preserve_format=True) -> DataFrame:
    """`servers` gives the fake of every server name; shares are numbered per server."""
    rows = _unc_parts(requests)
    shares = rows.select("server", "share").distinct().withColumn("_sh", salted_md5(F.col("share"), salt))
    numbered = ordinal(shares, ["server"], F.substring("_sh", 1, 3), [F.col("_sh"), F.col("share")], "_no")
    fake_share = F.concat(F.lit("Share"), F.col("_no").cast("string"), _hidden(F.col("share")))
    known = numbered.join(servers, "server").select(
        "server", "share", "fake_server",
        (F.when(F.col("share") == "", "").otherwise(fake_share) if preserve_format
         else F.col("share")).alias("fake_share"))
    # One share may hold most of the paths: spread it over several copies of its entry.
    rows = rows.withColumn("_salt", F.pmod(F.hash("original_value"), F.lit(_SALTS)))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.join(known, ["server", "share", "_salt"]).withColumn(
        "anonymized_value", _unc_path(F.col("fake_server"), F.col("fake_share"), tail))


# -- the whole map -----------------------------------------------------------------

def generate_map(identifiers: DataFrame, existing: DataFrame | None = None, salt: str = "",
                 preserve_format: bool = True, suffix: str = "mask", upn_domain: str = "mask",
                 linked: bool = False, unc_tail: str = "keep", scope: str = "project",
                 strict: bool = False, avoid: DataFrame | None = None) -> DataFrame:
    """MAP rows for the identifiers (identifier_type, value) that `existing` lacks.  Malformed ones are left out
    and are the rows of `malformed_identifiers`; with `strict` one of them ends the job.

    suffix       `mask` or `keep` what follows the first label of a dotted host name
    upn_domain   `mask`, or `second_label` for fabrikam.{second label of the domain}
    linked       a UNC server gets the fake of the host name it equals
    unc_tail     `keep` or `mask` the folders after the share
    avoid        (name): further names that count as in use
    """
    kind, value = F.col("identifier_type"), F.col("original_value")
    fresh = identifiers.select("identifier_type", F.col("value").alias("original_value"))
    reason = malformed(kind, value)
    if strict:
        error = F.raise_error(F.concat(reason, F.lit(": "), F.coalesce(value, F.lit("null"))))
        fresh = fresh.withColumn("identifier_type", F.coalesce(F.when(reason.isNotNull(), error).cast("string"), kind))
    else:
        fresh = fresh.where(reason.isNull())
    fresh = (fresh.groupBy("original_value").agg(F.max("identifier_type").alias("identifier_type")))
    if existing is not None:
        fresh = fresh.join(existing.select("original_value"), "original_value", "left_anti")
    # Used once per type below, so computed once and written.
    fresh = materialize(fresh.select("identifier_type", "original_value", salted_md5(value, salt).alias("h")), "identifiers")
    names = fresh.select(F.col("original_value").alias("name"))
    rows = 2 * fresh.count()
    if existing is not None:
        rows += 2 * existing.count()
        names = names.unionByName(existing.select(F.col("original_value").alias("name"))).unionByName(
            existing.select(F.col("anonymized_value").alias("name")))
    if avoid is not None:
        rows += avoid.count()
        names = names.unionByName(avoid.select("name"))

    small = rows <= _FEW_ROWS
    of = lambda *types: fresh.where(kind.isin(*types))
    hosts = of("hostname") if linked else of("hostname", "unc")
    labels = host_labels(hosts, names, small)
    host_fakes = labels.where(kind == "hostname").withColumn("anonymized_value", _host_name(
        F.col("label"), value, suffix, preserve_format))
    if linked:
        known = host_fakes.select(value.alias("server"), F.col("anonymized_value").alias("fake_server"))
        if existing is not None:
            known = known.unionByName(existing.where(kind == "hostname").select(
                value.alias("server"), F.col("anonymized_value").alias("fake_server")))
        known = materialize(known, "servers")
        unknown = _unc_parts(of("unc")).select(F.col("server").alias("original_value")).distinct().join(
            known, F.col("original_value") == known["server"], "left_anti").withColumn(
            "h", salted_md5(value, salt))
        taken = names.unionByName(known.select(F.col("fake_server").alias("name")))
        added = fake_hostname(unknown, taken, suffix, preserve_format, small).select(
            value.alias("server"), F.col("anonymized_value").alias("fake_server"))
        paths = fake_unc_linked(of("unc"), known.unionByName(added), salt, unc_tail, preserve_format)
    else:
        paths = fake_unc_alone(labels.where(kind == "unc"), suffix, unc_tail, preserve_format)

    fakes = [
        fake_address(of("ipv4", "cidr"), names, preserve_format, rows),
        host_fakes, fake_upn(of("upn"), names, upn_domain, preserve_format, small),
        fake_guid(of("guid"), names if avoid is not None else None), fake_sid(of("sid"), names),
        fake_mac(of("mac"), names, preserve_format, rows), paths,
    ]
    entries = reduce(DataFrame.unionByName, [
        f.select("identifier_type", "original_value", "anonymized_value") for f in fakes])
    return entries.withColumns({"scope": F.lit(scope), "preserve_format": F.lit(preserve_format)}).select(
        MAP_COLUMNS)
