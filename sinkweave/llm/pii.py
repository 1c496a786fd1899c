"""PII: detected entities get keyed surrogates of the same type, format, script and gender.

Detection and replacement are Spark expressions. Emails, phone numbers, card numbers, IP addresses,
IBANs, social security numbers and secrets are rewritten by a keyed permutation of their letters,
digits or address halves (each moves by a keyed hash of the others, both ways): it is one-to-one on
all strings of one shape, so an entity has the same surrogate wherever it stands and different ones
stay different. What is longer than HEAD characters moves as head and tail, each by a hash of the other
in turn, so the work grows with the length. Country codes, top-level domains, key prefixes and the check digit of card numbers
stay valid; a mail domain is rewritten by itself, so addresses of one domain keep one. Digit runs
are card numbers only if their first digit is an issuer's and their check digit is right.

Names are found after a title, as two or more capitalised words after a greeting, and as a known given
name with capitalised words after it; they run as long as capitalised words, initials and particles
(``van der``) follow each other. The last word is the family name, the others are given names; each is
an entity of its own, so ``Mr Smith`` and ``Mr John Paul Smith`` keep one family name. A given name gets
one of the gender that the title or the first given name tells, both in the name's script; initials
move in their alphabet, titles and particles stay. Where a document has such a name, its given and
family names are also replaced where they stand alone. Distinct entities of the whole corpus are checked: those whose
surrogate is their own text, and all but one of those that share a surrogate, are drawn again.

Defined results: null texts stay null and texts without entities stay as they are; a key must not be
empty; ties between entities that share a surrogate go by their text; repeated rows get the same
result; all columns are kept, whatever their names and types, but ``pii_entities`` and ``pii_kinds``,
which are the operator's own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sinkweave.llm.common import cut, fresh

KEY_CONF = "spark.sinkweave.pii.key"
#: Up to so many distinct entities are broadcast (their rows are under 1 KB); beyond, Spark shuffles.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 16 << 20
#: Longer entities move as a head of so many characters and a tail.
HEAD = 32
#: Distinct entities whose surrogates one task draws.
PER_TASK = 5_000

_MALE = r"Mr|Herr|Señor|Sr|Monsieur|господин|г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Señorita|Sra|Srta|Madame|Mme|Mlle|госпожа|г-жа"
_NEUTRAL = r"Dr|Prof"
_CAPITAL = r"[A-ZÀ-ÖØ-ÞЀ-Я][\p{L}'’-]*+"
#: Small words inside names, words before a name, and words after these that are none.
_PARTICLE = "van|von|vom|zu|zur|der|den|de|del|della|di|da|do|dos|du|la|le|al|bin|ibn|ter"
_GREETING = "Dear|Hello|Hi|Liebe|Lieber|Hallo|Estimado|Estimada|Querido|Querida|Cher|Chère|Bonjour|Уважаемый|Уважаемая|Дорогой|Дорогая"
_NOBODY = "Sir|Sirs|Madam|All|Everyone|Everybody|Team|Friend|Friends|Colleague|Colleagues|Customer|Customers|Client|Hiring|Editor|Editors|Members|Reader|Readers|World|Kitty|God|Lord|Santa|Mom|Mum|Dad|Kollegen|Kolleginnen|Kunde|Damen|Herren"
#: Common given names, by which names without a title are known.
COMMON = {
    "male": "John James Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Peter Hans Klaus Jürgen Stefan Wolfgang Johann Pierre Jacques Michel Philippe José Juan Miguel Pedro Luis Javier Дмитрий Алексей Михаил Владимир".split(),
    "female": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Anna Anne Emma Claudia Sabine Monika Petra Ursula Marie Camille Isabelle Sophie Nathalie Carmen Isabel Lucía Pilar Анна Мария Наталья Екатерина Татьяна".split(),
}
_GIVEN_WORDS = "|".join(COMMON["male"] + COMMON["female"])
_WORD = rf"(?:[A-ZА-Я]\.(?= )|{_CAPITAL})"
#: What a name, or a title, begins with: looked at first, as most places are inside words.
_BEGINS = "(?=[A-ZÀ-ÖØ-ÞЀ-Я])"
_TITLED = "(?=[A-Zг])"
_NEXT = rf"(?:(?: (?:{_PARTICLE}))*+ {_WORD})"
#: kind -> pattern, in the order in which they are tried at one place
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)*(?<=\.[A-Za-z]{2,24})",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[3-6](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"{_TITLED}(?<![\p{{L}}0-9])(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? {_WORD}{_NEXT}*+",
    "greeted": rf"{_BEGINS}(?<= )(?<=(?<![\p{{L}}0-9])(?:{_GREETING}) )(?!(?:{_NOBODY})(?![\p{{L}}])){_WORD}{_NEXT}++",
    "known": rf"{_BEGINS}(?<![\p{{L}}0-9'’-])(?:{_GIVEN_WORDS}){_NEXT}++",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has: a quick test before the patterns are tried at each place.
GATE = rf"[@0-9]|AKIA|gh[pousr]_|sk-|[a-f]{{32}}|[A-F]{{32}}|{_TITLED}(?:{_MALE}|{_FEMALE}|{_NEUTRAL})|{_BEGINS}(?:{_GREETING}|{_GIVEN_WORDS})"

GIVEN = {
    ("male", "latin"): "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Lukas Martin Nils Oskar Paul Robert Simon Tomas Victor".split(),
    ("female", "latin"): "Alma Berta Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Tina Vera".split(),
    ("male", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей Тимур".split(),
    ("female", "cyrillic"): "Алина Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Марина Нина Ольга Полина Раиса Софья".split(),
}
SYLLABLES = {
    "latin": "ba den fel gar hol kin lan mor nes pel rin sal tor vel win zan bren dal fos".split(),
    "cyrillic": "ба вол гор дан зар кин лен мор нов пет рин сав тор фед чер шил".split(),
}


_run_keys: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key of ``KEY_CONF``; without one, a random key for as long as the application runs."""
    return spark.conf.get(KEY_CONF, None) or _run_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def entities(text: Column, pattern: Column | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(ANY) if pattern is None else pattern, F.lit(0))
    return F.when(text.rlike(GATE), found).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        if kind in ("greeted", "known"):
            continue  # names too, which no other pattern fits
        whole = entity.rlike(rf"^(?:{pattern})$")
        out = F.when(whole, F.lit(kind)) if out is None else out.when(whole, F.lit(kind))
    return out.otherwise(F.lit("name"))


def _draw(key: str, *parts: Column) -> Column:
    """A keyed number under 2^52."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 13), 16, 10).cast("long")


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX, _UPPER_HEX = ("0123456789abcdef",), ("0123456789ABCDEF",)


def _shape(text: Column, sets) -> Column:
    """The text with every character that may change replaced by one that names its set."""
    return F.translate(text, "".join(sets), "".join(str(k) * len(letters) for k, letters in enumerate(sets)))


def _pass(text: Column, key: str, kind: Column, sets, forward: bool) -> Column:
    """Moves each character within its set by what stands before it (or, backward, after it). One
    pass can be undone from its first (last) character on, so it is one-to-one on each shape."""
    shape = _shape(text, sets)

    def moved(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        said = F.substring(text, F.lit(1), i - 1) if forward else F.substring(text, i + 1, F.length(text))
        by = _draw(key, kind, F.lit(str(int(forward))), shape, i.cast("string"), said)
        out = None
        for letters in sets:
            at = F.instr(F.lit(letters), c)
            new = F.substring(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))).cast("int") + 1, F.lit(1))
            out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
        return out.otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), moved), "")).otherwise(F.lit(""))


def _stream(text: Column, key: str, kind: Column, said: Column, sets) -> Column:
    """Moves each character within its set by its place and ``said``."""

    def moved(c: Column, i: Column) -> Column:
        by = _draw(key, kind, F.lit("tail"), said, i.cast("string"))
        out = None
        for letters in sets:
            at = F.instr(F.lit(letters), c)
            new = F.substring(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))).cast("int") + 1, F.lit(1))
            out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
        return out.otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), moved), "")).otherwise(F.lit(""))


def _by_sets(move) -> Column:
    """``move(sets)`` by the column ``_sets``, which says what characters may change."""
    return F.when(F.col("_sets") == "hex", move(_HEX)).when(F.col("_sets") == "HEX", move(_UPPER_HEX)).otherwise(move(_SETS))


def _permuted(rows: DataFrame, name: str, key: str, said: Column) -> DataFrame:
    """The column ``name`` moved: its tail by its head, its head both ways by the tail, its tail again."""
    head, tail = f"{name}_head", f"{name}_tail"
    rows = rows.withColumn(head, F.substring(name, 1, HEAD)).withColumn(tail, F.substring(F.col(name), F.lit(HEAD + 1), F.length(name)))
    rows = rows.withColumn(tail, _by_sets(lambda sets: _stream(F.col(tail), key, said, F.concat(F.lit("1"), head), sets)))
    rows = rows.withColumn("_seen", F.when(F.length(tail) > 0, F.concat(said, F.sha2(tail, 256))).otherwise(said))
    for forward in (True, False):
        rows = rows.withColumn(head, _by_sets(lambda sets, forward=forward: _pass(F.col(head), key, F.col("_seen"), sets, forward)))
    rows = rows.withColumn(tail, _by_sets(lambda sets: _stream(F.col(tail), key, said, F.concat(F.lit("2"), head), sets)))
    return rows.withColumn(name, F.concat(head, tail)).drop(head, tail, "_seen")


def _luhn(text: Column, shift: int) -> Column:
    """Sum of the Luhn values of a text's digits; shift 1: its last digit is the one before the check digit."""
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i + shift, F.lit(2)) == 1, F.floor(d / 5).cast("int") + F.pmod(2 * d, F.lit(10))).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, b: a + b)


def _ip(text: Column, tag: Column, key: str) -> Column:
    """The address as two 16-bit halves that move by each other in turn."""
    octet = [F.element_at(F.split(text, r"\."), k).cast("int") for k in (1, 2, 3, 4)]
    left, right = octet[0] * 256 + octet[1], octet[2] * 256 + octet[3]
    for r in range(3):
        if r % 2 == 0:
            left = F.pmod(left + _draw(key, tag, F.lit(str(r)), right.cast("string")), F.lit(65536))
        else:
            right = F.pmod(right + _draw(key, tag, F.lit(str(r)), left.cast("string")), F.lit(65536))
    return F.concat_ws(".", *[x.cast("string") for half in (left, right) for x in (F.floor(half / 256), F.pmod(half, F.lit(256)))])


def _picked(items: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), F.pmod(number, F.lit(len(items))).cast("int") + 1)


def _title_gender(title: Column, given: Column, key: str) -> Column:
    """Of a title; one that has none follows its given name."""
    bare = F.regexp_replace(title, r"\.$", "")
    drawn = F.when(F.pmod(_draw(key, F.lit("gender"), F.coalesce(given, F.lit(""))), F.lit(2)) == 0, "male").otherwise("female")
    told = F.when(given.isin(*COMMON["female"]), "female").when(given.isin(*COMMON["male"]), "male").otherwise(drawn)
    return F.when(bare.rlike(f"^(?:{_FEMALE})$"), "female").when(bare.rlike(f"^(?:{_MALE})$"), "male").otherwise(told)


def _name(text: Column, kind: Column, attempt: Column, key: str) -> Column:
    """Surrogates of given and family names: from the lists and syllables, longer with every draw."""
    cyrillic = text.rlike(r"\p{IsCyrillic}")
    number = _draw(key, kind, text, F.when(attempt > 0, attempt.cast("string")).otherwise(""))

    def built(script: str, least: int) -> Column:
        n = len(SYLLABLES[script])
        parts = [_picked(SYLLABLES[script], (number / n**k).cast("long")) for k in range(9)]
        return F.concat(*[F.lit(""), *parts[:least]], *[F.when(attempt > (k - least) // 2, parts[k]).otherwise("") for k in range(least, 9)])

    family = F.initcap(F.when(cyrillic, built("cyrillic", 3)).otherwise(built("latin", 3)))
    given = None
    for (gender, script), names in GIVEN.items():
        is_it = (kind == f"given {gender}") & (cyrillic == F.lit(script == "cyrillic"))
        picked = F.concat(_picked(names, _draw(key, F.lit("list"), text)), built(script, 0))
        given = F.when(is_it, picked) if given is None else given.when(is_it, picked)
    return F.when(kind == "family", family).otherwise(given)


def _initial(text: Column, key: str) -> Column:
    """Another letter of its alphabet, the same number of places on for all."""
    alphabets = [_SETS[2], "".join(map(chr, range(ord("А"), ord("Я") + 1)))]
    step = 1 + int(hashlib.sha256(f"{key}|initial".encode()).hexdigest(), 16) % 25
    return F.translate(text, "".join(alphabets), "".join(a[step:] + a[:step] for a in alphabets))


def with_surrogates(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``s``, the replacement, to rows of ``kind``, ``entity`` and ``attempt`` (how often it was
    drawn again). Every step is a column of its own, so no expression is nested deeply."""
    e, kind, attempt = F.col("entity"), F.col("kind"), F.col("attempt")
    tag = F.concat(kind, F.when(attempt > 0, attempt.cast("string")).otherwise(""))
    none = F.lit("")
    hexes = e.rlike("^[0-9a-f]{32,}$") | e.rlike("^[0-9A-F]{32,}$")
    email = r"^(.*)@(.*)(\.[A-Za-z]+)$"
    rows = rows.withColumn("_sets", F.when((kind == "secret") & hexes, F.when(e.rlike("[a-f]"), "hex").when(e.rlike("[A-F]"), "HEX").otherwise("hex")).otherwise("all"))
    # front, first permuted part, middle, second permuted part, end
    front = F.when(kind == "phone", F.regexp_extract(e, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 0)).when((kind == "secret") & ~hexes, F.regexp_extract(e, r"^(AKIA|gh[pousr]_|sk-)?", 0)).when(kind == "iban", F.substring(e, 1, 2)).when(kind == "card", F.substring(e, 1, 1)).otherwise(none)
    rows = rows.withColumn("_front", front)
    one = (
        F.when(kind == "email", F.regexp_extract(e, email, 1))
        .when(kind == "card", F.substring(e, F.lit(2), F.length(e) - 2))
        .when(kind.isin("phone", "secret", "iban", "ssn"), F.substring(e, F.length("_front") + 1, F.length(e)))
        .otherwise(none)
    )
    rows = rows.withColumn("_one", one).withColumn("_two", F.when(kind == "email", F.regexp_extract(e, email, 2)).otherwise(none))
    for name, said in (("_one", tag), ("_two", F.lit("domain"))):
        rows = _permuted(rows, name, key, said)
    check = F.pmod(-_luhn(F.concat("_front", "_one"), 1), F.lit(10)).cast("string")
    rows = rows.withColumn(
        "s",
        F.when(kind == "email", F.concat("_one", F.lit("@"), "_two", F.regexp_extract(e, email, 3)))
        .when(kind == "ip", _ip(e, tag, key))
        .when(kind == "card", F.concat("_front", "_one", check))
        .when(kind.isin("family", "given male", "given female"), _name(e, kind, attempt, key))
        .when(kind == "initial", _initial(e, key))
        .otherwise(F.concat("_front", "_one")),
    )
    return rows.drop("_sets", "_front", "_one", "_two")


def surrogates(found: DataFrame, key: str, most: int = 200) -> DataFrame:
    """``found(kind, entity)`` -> (kind, entity, s), distinct: no entity keeps its text, and no two of one
    kind share a surrogate. Distinct entities only, folded on the map side first."""
    distinct = cut(found.select("kind", "entity").distinct().withColumn("attempt", F.lit(0)), "pii-distinct")
    spread = distinct.repartition(distinct.count() // PER_TASK + 1)
    now = cut(with_surrogates(spread, key).select("kind", "entity", "attempt", "s"), "pii-entities")
    same = Window.partitionBy("kind", "s").orderBy("attempt", "entity")
    for _ in range(most):
        ranked = now.withColumn("nth", F.row_number().over(same))
        again = cut(ranked.filter("nth > 1 or s = entity").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), "pii-again")
        if again.isEmpty():
            return now.select("kind", "entity", "s")
        drawn = with_surrogates(again, key).select("kind", "entity", "attempt", "s")
        now = cut(now.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(drawn), "pii-entities")
    raise RuntimeError(f"surrogates still clash after {most} draws")


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast while rows and bytes are few."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("entity") + F.octet_length("s")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES else df


def _card(entity: Column) -> Column:
    return F.pmod(_luhn(entity, 0), F.lit(10)) == 0


def _parts(found: DataFrame, key: str) -> DataFrame:
    """Rows of ``entity``, ``kind`` as rows of parts: ``part``, ``kind``, ``entity``, ``as`` (the kind that
    is reported). Of a name, the title and particles stay (no kind); what is no card stays too."""
    words = F.split(F.col("entity"), " ")
    is_titled = F.get(words, F.lit(0)).rlike(rf"^(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.?$")
    title = F.when(is_titled, F.get(words, F.lit(0))).otherwise("")
    at = F.when(is_titled, 1).otherwise(0)
    given = F.when(F.size(words) - at > 1, F.get(words, at))
    gender = F.concat(F.lit("given "), _title_gender(title, given, key))
    none = F.lit(None).cast("string")

    def row_at(i: Column, word: Column) -> Column:
        kind = F.when((i < at) | word.rlike(rf"^(?:{_PARTICLE})$"), none).when(i == F.size(words) - 1, "family").when(word.rlike(r"^.\.$"), "initial").otherwise(gender)
        return F.struct(i.alias("part"), kind.alias("kind"), word.alias("entity"), F.lit("name").alias("as"))

    row = lambda n, kind, entity, told: F.struct(F.lit(n).alias("part"), kind.alias("kind"), entity.alias("entity"), told.alias("as"))
    told = F.when(F.col("kind").isin("family", "given male", "given female", "initial"), "name").otherwise(F.col("kind"))
    name = F.transform(words, lambda w, i: row_at(i, w))
    plain = F.when((F.col("kind") == "card") & ~_card(F.col("entity")), F.array(row(0, none, F.col("entity"), none))).otherwise(F.array(row(0, F.col("kind"), F.col("entity"), told)))
    return found.withColumn("_x", F.explode(F.when(F.col("kind") == "name", name).otherwise(plain))).drop("entity", "kind").select("*", "_x.*").drop("_x")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and two columns more: ``pii_entities`` (long) and
    ``pii_kinds`` (distinct, sorted, comma-joined).

    Only entities and their places are shuffled to be replaced; a document's come back as one array."""
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop("pii_entities", "pii_kinds")
    at_id, at_text = ["_pii_id", "_pii_text"], F.xxhash64("text")
    keyed = docs.select(F.col("doc_id").alias("_pii_id"), at_text.alias("_pii_text"), "text")
    found = keyed.select(*at_id, F.posexplode(entities(F.col("text"))).alias("at", "entity")).withColumn("kind", kind_of(F.col("entity")))
    found = cut(_parts(found.distinct(), key), "pii-found")  # of repeated rows once
    # names of a document where they stand without a title
    names = found.filter("kind in ('family', 'given male', 'given female')").select(*at_id, "entity", "kind").groupBy(*at_id, "entity").agg(F.min("kind").alias("kind"))
    names = names.groupBy(*at_id).agg(F.map_from_entries(F.collect_list(F.struct("entity", "kind"))).alias("words"))
    by_length = F.array_sort(F.map_keys("words"), lambda x, y: F.length(y) - F.length(x))
    names = cut(names.withColumn("pattern", F.concat(F.lit(ANY + r"|(?<![\p{L}0-9])(?:"), F.array_join(by_length, "|"), F.lit(r")(?![\p{L}0-9])"))), "pii-names")
    if not names.isEmpty():
        again = keyed.join(names.withColumnsRenamed({"_pii_id": "_id", "_pii_text": "_text"}), F.col("_pii_id").eqNullSafe(F.col("_id")) & (F.col("_pii_text") == F.col("_text")))
        again = again.select(*at_id, "words", F.posexplode(entities(F.col("text"), F.col("pattern"))).alias("at", "entity"))
        again = again.withColumn("kind", F.coalesce(F.try_element_at("words", F.col("entity")), kind_of(F.col("entity")))).drop("words").distinct()
        without = found.join(names.select(F.col("_pii_id").alias("_id"), F.col("_pii_text").alias("_text")), F.col("_pii_id").eqNullSafe(F.col("_id")) & (F.col("_pii_text") == F.col("_text")), "left_anti")
        found = cut(without.unionByName(_parts(again, key).select(*without.columns)), "pii-found")
    drawn = _bounded(surrogates(found.filter("kind is not null"), key))
    made = found.join(drawn, ["kind", "entity"], "left").withColumn("s", F.coalesce("s", "entity"))
    whole = made.groupBy(*at_id, "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda x: x["s"]), " ").alias("s"), F.max("as").alias("kind"))
    whole = whole.groupBy(*at_id).agg(
        F.array_sort(F.collect_list(F.struct("at", "s"))).alias("new"), F.count("kind").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    whole = whole.join(names.select(*at_id, "pattern").withColumnsRenamed({"_pii_id": "_id", "_pii_text": "_text"}), F.col("_pii_id").eqNullSafe(F.col("_id")) & (F.col("_pii_text") == F.col("_text")), "left").drop("_id", "_text")
    own = {c: fresh(docs, c) for c in (*at_id, "new", "n", "kinds", "pattern")}
    whole = whole.withColumnsRenamed(own)
    base = docs.join(whole, F.col("doc_id").eqNullSafe(F.col(own["_pii_id"])) & (at_text == F.col(own["_pii_text"])), "left")
    new, pattern = F.col(own["new"]), F.col(own["pattern"])
    put = lambda between: F.array_join(F.zip_with(between, new, lambda part, x: F.concat(part, F.coalesce(x["s"], F.lit("")))), "")
    text = F.when(new.isNull(), F.col("text")).when(pattern.isNull(), put(F.split("text", ANY, -1))).otherwise(put(F.split("text", pattern, -1)))
    return base.select(
        *[text.alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.coalesce(F.col(own["n"]), F.lit(0)).cast("long").alias("pii_entities"),
        F.coalesce(F.col(own["kinds"]), F.lit("")).alias("pii_kinds"),
    )
