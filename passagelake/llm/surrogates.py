"""Surrogate generation for personal data, in DataFrame functions alone.

Entities are found by one alternation of patterns; persons are found behind a title. An entity consists of atoms: a
person's are the parts of the name, any other entity is one. An atom's normal form (letters in lower case, or digits
without punctuation) and its type give, under a secret key, a surrogate of the same type: letters become letters of
the same script and case, digits digits, an address stays a valid address, a card number that passes the Luhn check
still passes it, a person's title stays and fixes the gender of the new given name. Punctuation and spacing are those
of the mention, so mentions of one entity in several formats stay mentions of one entity, and a surname is the same
with and without the given name.

Distinctness: a job groups the distinct atoms by (type, surrogate). Where several meet, or a surrogate equals a real
atom, all but the smallest draw again, until none collide. From the attempt WIDER on each draw is longer by one unit
(two letters, a digit; an address of four numbers becomes one of version 6), so the rounds end even if all surrogates
of an atom's own length are real. Only those exceptions are joined back to their documents; all others follow from
the key.

Defined cases: a null text stays null and has 0 entities; rows with equal or null ids are each rewritten; an empty
table gives an empty result; all columns are kept whatever their names (a column named as count_column is replaced);
overlapping patterns are taken from left to right, the first kind in PATTERNS at each place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .quality_cascade import let

FEMALE = r"Mrs|Ms|Miss|Madam|Mme|Mlle|Frau|Sra|Srta|Señora|Señorita|Madame|Mademoiselle"
MALE = r"Mr|Herr|Sr|Señor|Monsieur|Mister"
#: In the order in which they are tried; none has a capturing group.
PATTERNS = {
    "email": r"[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?:sk|pk|ghp|gho|glpat|xox[abp])[-_][A-Za-z0-9_-]{16,}|\b(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)",
    "person": r"\b(?i:" + FEMALE + "|" + MALE + r"|Dr|Prof)\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity: each pattern's every branch contains one. This scan is cheaper than ANY.
HINT = r"@|\d[\d.: ()-]{5}|[0-9a-fA-F]{16}|\b(?:AKIA[0-9A-Z]|[A-Z]{2}\d{2} ?[A-Z0-9]{4})|\b(?:sk|pk|ghp|gho|glpat|xox[abp])[-_]|\b(?i:" + FEMALE + "|" + MALE + r"|Dr|Prof)\.? "
TITLE = r"^(?i:" + FEMALE + "|" + MALE + r"|Dr|Prof)\.? "
HEX_DIGITS = 256
WIDER = 4

Surrogate = Callable[[Column, Column, Column], Column]


def kind_of(mention: Column) -> Column:
    out = F.lit("person")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def gender_of(mention: Column) -> Column:
    return F.when(mention.rlike(f"^(?i:{FEMALE})\\b"), "f").when(mention.rlike(f"^(?i:{MALE})\\b"), "m").otherwise("n")


def normal(mention: Column, kind: Column) -> Column:
    """What mentions of one entity have in common."""
    digits, compact = F.regexp_replace(mention, r"[^\d]", ""), F.regexp_replace(F.lower(mention), r"[ -]", "")
    name = F.concat(gender_of(mention), F.lit(":"), F.lower(F.regexp_replace(mention, TITLE, "")))
    return F.when(kind.isin("card", "national_id", "phone"), digits).when(kind == "iban", compact).when(kind == "person", name).when(kind == "secret", mention).otherwise(F.lower(mention))


def _letter(c: Column, v: Column) -> Column:
    """A letter or digit of c's own script, chosen by v; other characters stay."""
    at = lambda first, size: F.chr(F.lit(first) + v % size)
    other = lambda first, size: F.decode(F.unhex(F.lpad(F.hex(F.lit(first) + v % size), 4, "0")), "UTF-16BE")
    return (
        F.when(c.rlike("^[0-9]$"), at(48, 10))
        .when(c.rlike("^[aeiou]$"), F.substring(F.lit("aeiou"), (v % 5 + 1).cast("int"), F.lit(1)))
        .when(c.rlike("^[a-z]$"), F.substring(F.lit("bcdfghjklmnpqrstvwxyz"), (v % 21 + 1).cast("int"), F.lit(1)))
        .when(c.rlike("^[A-Z]$"), at(65, 26))
        .when(c.rlike(r"^\p{IsCyrillic}$"), other(0x430, 32))
        .when(c.rlike(r"^\p{IsGreek}$"), other(0x3B1, 17))
        .when(c.rlike(r"^\p{IsHan}$"), other(0x4E00, 20000))
        .when(c.rlike(r"^\p{L}$"), at(97, 26))
        .when(c.rlike(r"^\p{N}$"), at(48, 10))
        .otherwise(c)
    )


def _stream(secret: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """HEX_DIGITS keyed hexadecimal digits."""
    part = lambda i: F.sha2(F.concat_ws("\u0001", F.lit(secret), kind, norm, attempt.cast("string"), F.lit(str(i))), 256)
    return F.concat(*[part(i) for i in range(HEX_DIGITS // 64)])


def _number(stream: Column, at: Column, hex_digits: int = 4) -> Column:
    start = F.pmod(at * hex_digits, F.lit(HEX_DIGITS)) + 1
    return F.conv(F.substring(stream, start.cast("int"), F.lit(hex_digits)), 16, 10).cast("long")


def luhn_sum(digits: Column) -> Column:
    """The Luhn check's sum, over a string of digits; valid where a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", F.lit(0)).otherwise(F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def atoms(kind: Column, norm: Column) -> Column:
    """The entity's parts that get surrogates of their own: (kind, norm); a name's norm has the gender that its ending shows in front of a colon."""
    gender, parts = F.substring(norm, 1, 1), F.split(F.substring(norm, F.lit(3), F.length(norm)), " ")
    shows = lambda p, i: (i == 0) & (F.size(parts) > 1) & (gender != "n") & p.rlike("[a-z]$")
    names = F.transform(parts, lambda p, i: F.struct(F.lit("name").alias("kind"), F.concat(F.when(shows(p, i), gender).otherwise(""), F.lit(":"), p).alias("norm")))
    return F.when(kind == "person", names).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"))))


def visible(kind: Column, norm: Column) -> Column:
    return F.when(kind == "name", F.regexp_replace(norm, "^[fm]?:", "")).otherwise(norm)


def keyed(secret: str) -> Surrogate:
    """(an atom's kind, normal form, attempt) -> its surrogate, of the same shape; wider from the attempt WIDER on."""

    def make(kind: Column, norm: Column, attempt: Column) -> Column:
        extra = F.greatest(attempt - (WIDER - 1), F.lit(0)).cast("int")

        def body(stream: Column) -> Column:
            mapped = lambda text: F.concat_ws("", F.transform(F.split(text, ""), lambda c, i: _letter(c, _number(stream, i))))
            padded = lambda text, unit: F.concat(text, F.repeat(unit, extra))
            zeros = lambda text: padded(text, F.lit("0"))
            ip4 = F.concat_ws(".", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(stream, i) % 254 + 1).cast("string")))
            ip6 = F.concat(F.lit("2001:db8:"), F.concat_ws(":", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(stream, (i * 4 + 1).cast("int"), F.lit(4)))))
            domain_end = F.regexp_extract(norm, r"\.[^.]+$", 0)
            email = F.concat(mapped(F.concat(F.repeat(F.lit("ba"), extra), F.regexp_replace(norm, r"\.[^.]+$", ""))), domain_end)
            first, rest = F.substring(norm, 1, 1), F.substring(norm, F.lit(2), F.length(norm) - 1)
            front = F.concat(first, mapped(zeros(F.substring(norm, F.lit(2), F.length(norm) - 2))))
            check = F.pmod(10 - luhn_sum(F.concat(front, F.lit("0"))), F.lit(10)).cast("string")
            number = F.concat(first, mapped(zeros(rest)))
            card = F.when(luhn_sum(norm) % 10 == 0, F.concat(front, check)).otherwise(number)
            last = F.substring(norm, -1, 1)
            secret_text = F.when(norm.rlike("^[0-9a-fA-F]+$"), F.concat_ws("", F.transform(F.split(padded(norm, last), ""), lambda c, i: F.substring(F.when(norm == F.upper(norm), F.upper(stream)).otherwise(stream), (F.pmod(i, F.lit(HEX_DIGITS)) + 1).cast("int"), F.lit(1))))).otherwise(mapped(padded(norm, last)))
            part = visible(kind, norm)
            # an ending shows the gender of a given name
            ending = F.when(norm.startswith("f:"), "a").when(norm.startswith("m:"), "o").otherwise("")
            drawn = mapped(padded(part, F.when(part.rlike("[a-z]$"), "ba").otherwise(F.substring(part, -1, 1))))
            name = F.when(ending != "", let(drawn, lambda n: F.concat(F.substring(n, F.lit(1), F.length(n) - 1), ending))).otherwise(drawn)
            iban = F.concat(F.substring(norm, 1, 2), mapped(padded(F.substring(norm, F.lit(3), F.length(norm) - 2), F.lit("0"))))
            return F.when(kind == "name", name).when(kind == "ip", F.when(extra > 0, ip6).otherwise(ip4)).when(kind == "email", email).when(kind == "card", card).when(kind.isin("phone", "national_id"), number).when(kind == "secret", secret_text).otherwise(iban)

        # a name's surrogate is drawn alike whatever gender its ending shows
        return let(_stream(secret, kind, visible(kind, norm), attempt), body)

    return make


def rendered(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate (of a person: of the name) in the mention's own format: its punctuation, its title, its case."""
    digits = F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")), lambda a, c: F.when(c.rlike("^[0-9A-Za-z]$"), F.struct(F.concat(a["t"], F.substring(surrogate, a["k"], F.lit(1))).alias("t"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["t"], c).alias("t"), a["k"].alias("k"))), lambda a: F.concat(a["t"], F.substring(surrogate, a["k"], F.length(surrogate))))
    cased = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(surrogate)
    title = F.regexp_extract(mention, TITLE, 0)
    rest = F.regexp_replace(mention, TITLE, "")
    person = F.concat(title, F.when(rest == F.upper(rest), F.upper(surrogate)).otherwise(F.initcap(surrogate)))
    return F.when(kind.isin("card", "national_id", "phone"), digits).when(kind == "iban", F.upper(digits)).when(kind == "person", person).when(kind == "email", cased).otherwise(surrogate)


def mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The distinct atoms (kind, norm) of the table."""
    found = docs.select(F.explode(mentions(F.col(f"`{text_column}`"))).alias("mention")).distinct()
    found = found.withColumn("kind", kind_of(F.col("mention")))
    return found.select(F.explode(atoms(F.col("kind"), normal(F.col("mention"), F.col("kind")))).alias("atom")).select("atom.*").distinct()


def exceptions(found: DataFrame, make: Surrogate) -> DataFrame | None:
    """(kind, norm, attempt) of the atoms that must not use attempt 0; None if there are none. Rounds end when none collide."""
    found = stored(found.withColumn("attempt", F.lit(0)), "entities")
    moved = False
    while True:
        drawn = found.withColumn("s", make(F.col("kind"), F.col("norm"), F.col("attempt")))
        # the smallest atom keeps a surrogate; what a real one looks like belongs to that one alone
        claims = drawn.select("kind", "s", "norm", F.lit(1).alias("drawn")).unionByName(found.select("kind", visible(F.col("kind"), F.col("norm")).alias("s"), "norm", F.lit(0).alias("drawn")))
        owner = claims.groupBy("kind", "s").agg(F.min(F.struct("drawn", "norm")).alias("o"), F.count("*").alias("n")).filter("n > 1")
        losing = drawn.join(owner, ["kind", "s"]).filter((F.col("o.drawn") == 0) | (F.col("o.norm") != F.col("norm"))).select("kind", "norm", F.lit(1).alias("again"))
        losing = stored(losing, "collisions")
        if losing.isEmpty():
            break
        moved, before = True, found
        found = stored(found.join(losing, ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "entities")
        discard(before)
        discard(losing)
    return found.filter("attempt > 0") if moved else None


def replace_entities(docs: DataFrame, key: str, text_column: str = "text", count_column: str | None = None, make: Surrogate | None = None) -> DataFrame:
    """docs with every entity's mentions replaced, under the secret `key`; count_column adds their number."""
    make = make or keyed(key)
    special = exceptions(entities(docs, text_column), make)
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of the input meets one of the columns made here
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    text = F.col(own[text_column])
    name_of = lambda kind, norm: F.concat_ws("\u0001", kind, norm)
    if special is not None:
        # only texts that mention an exception take part in this join; its size is that of the exceptions' mentions
        prints = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), text, F.lit(29)).alias("h2")]
        hit = rows.filter(text.rlike(HINT)).select(*prints, F.explode(F.array_distinct(mentions(text))).alias("mention"))
        hit = hit.withColumn("kind", kind_of(F.col("mention"))).select("h1", "h2", F.explode(atoms(F.col("kind"), normal(F.col("mention"), F.col("kind")))).alias("atom"))
        hit = hit.select("h1", "h2", "atom.*").distinct().join(special, ["kind", "norm"])
        attempts = hit.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct(name_of(F.col("kind"), F.col("norm")), "attempt"))).alias("attempts"))
        rows = rows.select("*", *prints).join(attempts, ["h1", "h2"], "left")
    attempt = (lambda k, n: F.coalesce(F.col("attempts")[name_of(k, n)], F.lit(0))) if special is not None else (lambda k, n: F.lit(0))
    drawn = lambda k, m: F.concat_ws(" ", F.transform(atoms(k, normal(m, k)), lambda a: make(a["kind"], a["norm"], attempt(a["kind"], a["norm"]))))
    new = lambda m: let(kind_of(m), lambda k: let(drawn(k, m), lambda s: rendered(m, k, s)))
    rows = rows.withColumn("mentions", mentions(text))
    gaps = F.split(text, ANY, -1)
    woven = F.concat_ws("", F.zip_with(gaps, F.transform("mentions", new), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))))
    made = {text_column: F.when(F.size("mentions") > 0, woven).otherwise(text)}
    if count_column:
        made[count_column] = F.coalesce(F.size("mentions"), F.lit(0)).cast("long")
    names = [*docs.columns, *(c for c in made if c not in own)]
    return rows.select(*[(made[c] if c in made else F.col(own[c])).alias(c) for c in names])
