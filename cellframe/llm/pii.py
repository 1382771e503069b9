"""Surrogates for personal data, in column expressions only.

Entities are found by patterns. Each distinct one (by type and canonical form) gets a
replacement of its own type, format, script and, for names, gender, derived from a keyed hash;
the same entity gets the same replacement everywhere. Over the table of all distinct entities
it is checked that no two share a replacement and that none is itself an entity of the corpus;
those that fail are derived anew until all pass.

A family name is an entity of its own, so "Dr Smith" and "Mr John Smith" have one family name after
as before. Persons are found after forms of address alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.shared import cut, free_name, whole_text

KEY = "surrogate-key-1"
#: Derivations of an entity that are tried at most; more is an error, not a silent collision.
ATTEMPTS = 12

# Forms of address by gender, and given names by gender and script.
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "κυρία")
TITLES_OF_ANY = ("Dr", "Prof", "Professor", "Doctor")
GIVEN = {
    ("male", "latin"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oscar", "Paul"),
    ("female", "latin"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Ida", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("male", "cyrillic"): ("Алексей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("female", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения"),
    ("male", "greek"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος"),
    ("female", "greek"): ("Άννα", "Βασιλική", "Γεωργία", "Ειρήνη", "Ελένη", "Μαρία", "Σοφία", "Χριστίνα"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fel", "gor", "hin", "kam", "lor", "mer", "nat", "pol", "ras", "sil", "tov", "var", "win", "zel"),
    "greek": ("βα", "γο", "δελ", "ζι", "θαν", "καλ", "λου", "μερ", "νικ", "παν", "ρο", "σιλ", "τασ", "φιλ", "χαρ", "ψι"),
    "cyrillic": ("ба", "вен", "гор", "дал", "зин", "кам", "лор", "мер", "нат", "пол", "рас", "сил", "тов", "фел", "хан", "чар"),
}
LETTERS, CYRILLIC, ACCENTED = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
# Country codes of telephone numbers; those not of one or two digits have three.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = "(?:" + "|".join((*MALE_TITLES, *FEMALE_TITLES, *TITLES_OF_ANY)) + ")"
#: Types in the order in which a match is tried; all begin at the start of a word.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*\.)+\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    # whole addresses or shortened ones of the ranges that are dealt out
    "ip6": r"(?<![\p{L}\p{N}:.])(?:[23][0-9A-Fa-f]{3}|[fF][cCdDeE][0-9A-Fa-f]{2}):(?:(?:[0-9A-Fa-f]{1,4}:){6}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[1-9](?:[ .-]?\(?[0-9]\)?){6,14}(?![\p{L}\p{N}])|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}]))",
    "ssn": r"(?<![\p{L}\p{N}])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.? \p{{Lu}}\p{{L}}+(?: (?!{_TITLE}(?!\p{{L}}))\p{{Lu}}\p{{L}}+)?",
}
#: One pattern for all. A look at the first character saves the engine most of its starts.
ANY = "(?=[\\p{L}\\p{N}+(])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def kind_of(value: Column) -> Column:
    out = F.when(bare_name(value).contains(" "), "person").otherwise("family")
    for kind, pattern in reversed([x for x in PATTERNS.items() if x[0] != "person"]):
        # the match stood alone, so what its pattern asks of neighbours holds
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    """What makes two mentions the same entity: digits of numbers, with a plus where the country is said,
    lower case of the rest."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    plain = F.lower(value)
    name = F.concat_ws(":", gender(value), F.lower(bare_name(value)))
    phone = F.when(value.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    numbers = F.when(kind == "phone", phone).when(kind.isin("ssn", "card"), digits).when(kind == "iban", F.regexp_replace(plain, " ", ""))
    return F.coalesce(numbers, F.when(kind == "person", name).when(kind == "family", F.lower(bare_name(value))).otherwise(plain))


def family_of(canon: Column) -> Column:
    return F.substring_index(canon, " ", -1)


def parts(value: Column) -> Column:
    """The entities (kind, canon) of one mention: itself, and the family name of a whole name."""
    entity = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    each = lambda k: bound(canonical(k, value), lambda c: F.when(k == "person", F.array(entity(k, c), entity(F.lit("family"), family_of(c)))).otherwise(F.array(entity(k, c))))
    return bound(kind_of(value), each)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def gender(value: Column) -> Column:
    starts = lambda titles: value.rlike(f"^(?:{'|'.join(titles)})\\.? ")
    return F.when(starts(MALE_TITLES), F.lit("male")).when(starts(FEMALE_TITLES), F.lit("female")).otherwise(F.lit("any"))


def bare_name(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{_TITLE}\.? ", "")


def stream(seed: Column, n: Column) -> Column:
    """A keyed stream of at least ``n`` numbers, as hexadecimal digits."""
    return F.array_join(F.transform(F.sequence(F.lit(0), (n / 16).cast("int")), lambda i: F.sha2(F.concat(seed, F.lit("#"), i.cast("string")), 256)), "")


def noise(hexes: Column, at: Column) -> Column:
    """The number from 0 to 65535 at a place (from 0) of a stream."""
    return F.conv(F.substring(hexes, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


def pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), n % len(chars) + 1, F.lit(1))


def other_characters(value: Column, hexes: Column, hexadecimal: Column, kept: Column) -> Column:
    """Each digit and letter replaced by one of its kind, from place ``kept`` of the end on as is."""
    n = F.length(value)

    def one(i: Column) -> Column:
        c, r = F.substring(value, i + 1, F.lit(1)), noise(hexes, i)
        return (
            F.when(i >= n - kept, c)
            .when(hexadecimal & c.rlike("[0-9a-f]"), pick("0123456789abcdef", r))
            .when(c.rlike("[0-9]"), pick("0123456789", r))
            .when(c.rlike("[a-z]"), pick(LETTERS, r))
            .when(c.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC, r))
            .when(c.rlike(r"\p{IsGreek}"), pick(GREEK, r))
            .when(c.rlike(r"\p{L}"), pick(ACCENTED, r))
            .otherwise(c)
        )

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")).otherwise(value)


def luhn_sum(digits: Column) -> Column:
    """Sum by which a card number is checked, for a number of any length."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def iban_rest(iban: Column) -> Column:
    """Remainder by which an account number in lower case is checked; 1 if it is right."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(total: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), total * 10 + c.cast("int")).otherwise(total * 100 + F.ascii(c) - 87) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def script_of(canon: Column) -> Column:
    return F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def syllables(script: Column, hexes: Column, n: Column, first: int) -> Column:
    """``n`` syllables of a script, from place ``first`` of a stream on."""
    out = F.lit("")
    for name, known in SYLLABLES.items():
        choice = F.array(*map(F.lit, known))
        word = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.element_at(choice, noise(hexes, i + first) % len(known) + 1)), "")  # noqa: B023
        out = F.when(script == name, word).otherwise(out)
    return out


def given_name(canon: Column, hexes: Column, attempt: Column) -> Column:
    """A given name in lower case of a person's gender and script, or of either gender where none is
    said; later derivations have syllables more, and so more room."""
    sex, script = F.substring_index(canon, ":", 1), script_of(canon)
    out = F.lit("")
    for letters in SYLLABLES:
        for one in ("male", "female", "any"):
            names = [n for (s, t), some in GIVEN.items() for n in some if t == letters and one in (s, "any")]
            chosen = F.element_at(F.array(*[F.lit(n.lower()) for n in names]), noise(hexes, F.lit(0)) % len(names) + 1)
            out = F.when((sex == one) & (script == letters), chosen).otherwise(out)
    return F.concat(out, syllables(script, hexes, attempt, 1))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY, family: Column | None = None) -> Column:
    """The canonical form of an entity's replacement; a person's has a family name that was derived before,
    by default the first derivation's."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    tail = F.when(kind == "email", F.length(F.regexp_extract(canon, r"\.\p{L}+$", 0))).otherwise(F.lit(0))
    last = family if family is not None else family_name(family_of(canon), F.lit(0), key)

    def by_kind(hexes: Column) -> Column:
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (noise(hexes, i) % 254 + 1).cast("string")), ".")
        name = F.concat(F.substring_index(canon, ":", 1), F.lit(":"), given_name(canon, hexes, attempt), F.lit(" "), last)
        spelled = other_characters(canon, hexes, kind.isin("secret", "ip6"), tail)
        out = F.when(kind == "ip", octets).when(kind == "person", name).when(kind == "family", syllables(script_of(canon), hexes, attempt + 3, 1))
        return out.otherwise(bound(spelled, checked))

    def checked(spelled: Column) -> Column:
        bank = F.concat(F.substring(canon, 1, 2), F.lit("00"), F.substring(spelled, F.lit(5), F.length(canon)))
        iban = F.when(iban_rest(canon) == 1, F.concat(F.substring(canon, 1, 2), F.lpad((98 - iban_rest(bank)).cast("string"), 2, "0"), F.substring(bank, F.lit(5), F.length(canon))))
        iban = iban.otherwise(F.concat(F.substring(canon, 1, 2), F.substring(spelled, F.lit(3), F.length(canon))))
        # a telephone number keeps its country code
        abroad = F.when(canon.startswith("+"), F.length(F.regexp_extract(F.substring(canon, F.lit(2), F.length(canon)), COUNTRY, 0)) + 1).otherwise(F.lit(0))
        phone = F.concat(F.substring(canon, F.lit(1), abroad), F.substring(spelled, abroad + 1, F.length(canon)))
        body = F.substring(spelled, F.lit(1), F.length(canon) - 1)
        check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
        card = F.when(luhn_sum(canon) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(spelled)
        # an address stays in its range
        ip6 = F.concat(F.substring(canon, 1, 4), F.substring(spelled, F.lit(5), F.length(canon)))
        return F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip6", ip6).otherwise(spelled)

    return bound(seed, lambda s: bound(stream(s, F.length(canon) + attempt), by_kind))


def family_name(canon: Column, attempt: Column, key: str = KEY) -> Column:
    """What surrogate() gives for a family name."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("family"), canon, attempt.cast("string")), 256)
    return bound(seed, lambda s: bound(stream(s, F.length(canon) + attempt), lambda h: syllables(script_of(canon), h, attempt + 3, 1)))


def render(kind: Column, value: Column, new: Column) -> Column:
    """A replacement in the format of one mention: its separators, letter case and title."""
    n = F.length(value)

    def digit(i: Column, new: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.upper(F.substring(new, before, F.lit(1)))).otherwise(c)

    def letter(i: Column) -> Column:
        c, r = F.substring(value, i, F.lit(1)), F.substring(new, i, F.lit(1))
        return F.when(c != F.lower(c), F.upper(r)).otherwise(r)

    each = F.sequence(F.lit(1), n)
    title, bare = F.regexp_extract(value, rf"^{_TITLE}\.? ", 0), bare_name(value)
    plain = F.substring_index(new, ":", -1)
    name = F.concat(title, F.when(bare == F.upper(bare), F.upper(plain)).otherwise(F.initcap(plain)))
    numbers = bound(F.regexp_replace(new, "[+]", ""), lambda new: F.array_join(F.transform(each, lambda i: digit(i, new)), ""))
    spelled = F.array_join(F.transform(each, letter), "")
    hexes = F.when(value.rlike("[A-F]") & ~value.rlike("[a-f]"), F.upper(new)).otherwise(new)
    return F.when(kind.isin("phone", "ssn", "card", "iban"), numbers).when(kind == "ip", new).when(kind.isin("person", "family"), name).when(kind.isin("secret", "ip6"), hexes).otherwise(spelled)


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct entities of all texts: kind, canon."""
    found = docs.select(F.explode(F.array_distinct(mentions(whole_text(text)))).alias("value"))
    return found.select(F.explode(parts(F.col("value"))).alias("e")).select("e.kind", "e.canon").distinct()


def settle(found: DataFrame, derived: Column) -> DataFrame:
    """``found`` with attempt and ``derived``, as surrogate, once no two are the same and none is an entity."""
    names = found.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
    kept = found.columns
    out = found.withColumn("attempt", F.lit(0))
    same = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon")
    for _ in range(ATTEMPTS):
        out = out.withColumn("surrogate", derived)
        out = out.withColumn("place", F.row_number().over(same)).join(names, ["kind", "surrogate"], "left")
        out = cut(out.select(*kept, "attempt", "surrogate", ((F.col("place") > 1) | F.col("taken").isNotNull()).alias("again")))
        if out.filter("again").isEmpty():
            return out.drop("again")
        out = out.select(*kept, F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
    raise ValueError(f"replacements still collide after {ATTEMPTS} derivations")


def derive(found: DataFrame, key: str = KEY) -> DataFrame:
    """A replacement for each entity, all different and none of them an entity: kind, canon,
    attempt, surrogate. Entities that fail a check are derived anew; the others stay. Whole names come last:
    two of them can share a replacement only if they share their family name."""
    # a number of partitions of its own: entities are small and would all end up in one task
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(found.repartition(partitions, "kind", "canon"))
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    alone = settle(found.filter(kind != "person"), surrogate(kind, canon, attempt, key))
    family = alone.filter(kind == "family").select(canon.alias("_name"), F.col("surrogate").alias("_family"))
    persons = found.filter(kind == "person").join(family, family_of(canon) == F.col("_name")).select("kind", "canon", "_family")
    return alone.unionByName(settle(persons, surrogate(kind, canon, attempt, key, F.col("_family"))).drop("_family"))


def replace(docs: DataFrame, text: str = "text", key: str = KEY, doc_id: str = "doc_id", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in their texts and, if asked for, how many mentions there were.

    Null texts stay null, empty ones empty, and a text without entities stays as it is, to the
    byte. Rows map one to one, repeated or not; other columns stay, and a column named
    ``count`` is replaced. Replacements that the first derivation gives are worked out in place
    from the keyed hash; only the later derivations of colliding entities are joined in, by
    document. A null doc_id counts as an identifier.
    """
    named = derive(entities(docs, text), key).filter(F.col("attempt") > 0).select("kind", "canon", "attempt")
    out = docs
    id_, found_, gaps_, later_ = (free_name(x, docs) for x in ("_id", "_found", "_gaps", "_later"))
    if named.isEmpty():
        later = F.lit(None).cast("map<string,int>")
    else:
        value = docs.select(F.col(doc_id).alias(id_), F.explode(F.array_distinct(mentions(whole_text(text)))).alias("value"))
        value = value.select(id_, F.explode(parts(F.col("value"))).alias("_e")).select(id_, "_e.kind", "_e.canon")
        again = value.join(named, ["kind", "canon"]).select(id_, F.struct(F.concat_ws("|", "kind", "canon").alias("k"), "attempt").alias("e")).distinct()
        again = again.groupBy(id_).agg(F.map_from_entries(F.collect_list("e")).alias(later_))
        out = out.join(again, F.col(doc_id).eqNullSafe(F.col(id_)), "left").drop(id_)
        later = F.col(later_)

    tries = lambda kind, canon: F.coalesce(F.try_element_at(later, F.concat_ws("|", kind, canon)), F.lit(0))

    def one(value: Column) -> Column:
        def new(e: Column) -> Column:
            family = family_of(e["canon"])
            last = family_name(family, tries(F.lit("family"), family), key)
            return render(e["kind"], value, surrogate(e["kind"], e["canon"], tries(e["kind"], e["canon"]), key, last))

        return bound(parts(value)[0], new)

    found = mentions(F.col(text))
    gaps = F.split(F.col(text), ANY, -1)
    filled = F.concat(F.array_join(F.zip_with(F.slice(F.col(gaps_), 1, F.size(found_)), F.transform(found_, one), lambda g, s: F.concat(g, s)), ""), F.element_at(gaps_, -1))
    out = out.withColumn(found_, found).withColumn(gaps_, F.when(F.size(found_) > 0, gaps))
    out = out.withColumn(text, F.when(F.size(found_) > 0, filled).otherwise(F.col(text)))
    if count:
        out = out.withColumn(count, F.greatest(F.size(found_), F.lit(0)))
    return out.drop(found_, gaps_, later_)
