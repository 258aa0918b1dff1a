"""Personal data: detection and keyed, type-consistent surrogates (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import checkpointed, let, private_names

# Titles that announce a name, by gender and script, and names to put in their place.
TITLES = {
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"],
    ("m", "latin"): ["Mr", "Herr", "Monsieur", "Señor", "Sr"],
    ("n", "latin"): ["Dr", "Prof"],
    ("f", "cyrillic"): ["Г-жа", "Госпожа"],
    ("m", "cyrillic"): ["Г-н", "Господин"],
    ("f", "greek"): ["Κυρία"],
    ("m", "greek"): ["Κύριος"],
}
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Greta", "Ida", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia"],
    ("m", "latin"): ["Adam", "Bruno", "Daniel", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oskar", "Paul", "Simon"],
    ("n", "latin"): ["Alex", "Andrea", "Charlie", "Kim", "Noel", "Robin", "Sascha", "Toni"],
    ("f", "cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Иван", "Олег", "Павел", "Сергей"],
    ("f", "greek"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("m", "greek"): ["Ανδρέας", "Γιώργος", "Νίκος", "Πέτρος"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fer", "gol", "han", "ker", "lan", "mor", "nel", "per", "ras", "sol", "tam", "ver", "win", "zan"],
    "cyrillic": ["ба", "ден", "вер", "гол", "зан", "кер", "лан", "мор", "нел", "пер", "рас", "сол", "там", "тор", "вин", "дан"],
    "greek": ["βα", "δεν", "φερ", "γολ", "ζαν", "κερ", "λαν", "μορ", "νελ", "περ", "ρασ", "σολ", "ταμ", "τορ", "βιν", "δαν"],
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
# Words that are no names though they may begin with a capital, as at the beginning of a sentence.
NO_NAMES = """
The An This That These Those He She It We They You His Her Its Our Their My Your And But Or So Then There Here However Therefore
When While If As At By For From In Of On To With Without After Before Because Since Although Not No Yes Is Are Was Were Has Have Had
Who What Which Where Why How Street Avenue Road Square Monday Tuesday Wednesday Thursday Friday Saturday Sunday
Der Die Das Ein Eine Einen Einem Einer Er Sie Es Wir Ihr Ich Du Am Im Zum Zur Vom Beim An Auf Aus Bei Bis Durch Für Gegen Mit Nach Ohne Seit Um Unter
Von Vor Während Wegen Zu Zwischen Und Oder Aber Denn Doch Dann Da Als Wenn Weil Dass Ob Auch Noch Nur Schon Sehr Nicht Kein Keine Heute Gestern
Straße Strasse Platz Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag
Il Elle On Nous Vous Ils Elles Je Ce Cette Ces Et Mais Ou Donc Car Si Quand Dans Sur Sous Avec Sans Pour Par Chez Après Avant Rue
Él Ella Ellos Ellas Nosotros Pero Cuando En Con Sin Por Para Desde Hasta Sobre Calle
""".split()
_NO_NAME = rf"(?!(?:{'|'.join(sorted(set(NO_NAMES)))})(?![\p{{L}}\p{{M}}'’]))"
# A capitalised word (no "'s" at its end) or an initial before another; and small words inside a name.
# Possessive repeats of groups take no stack, so names and secrets need no upper bound.
_WORD = r"\p{Lu}(?:(?:[\p{L}\p{M}]|['’](?=\p{L})(?![sS](?!\p{L})))++|\.(?= \p{Lu}))"
_PARTICLES = r"(?:(?:van|von|der|den|de|del|della|di|da|du|la|le|los|las|zu|y) )*+"
#: Tried in this order at every place; a card number must also pass its check digit.
PATTERNS = {
    "secret": r"""(?i:api[_ -]?key|access[_ -]?key|token|secret|password|passwd)(?:\\?["'])?\s{0,3}[=:]\s{0,3}(?:"""
    + r"""\\?"(?=[^"\s\p{L}\p{N}]*+[\p{L}\p{N}])[^"\s]{8,}+|\\?'(?=[^'\s\p{L}\p{N}]*+[\p{L}\p{N}])[^'\s]{8,}+"""
    + r"""|["']?(?=[_+/=~.\-]*+[A-Za-z0-9])[A-Za-z0-9_+/=~.\-]{7,}[A-Za-z0-9_+/=~\-])""",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_%+\-][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?<![\d(])(?:\+\d{1,3}[ \-]?)?(?:\(\d{2,4}\)[ \-]?\d{3,4}[ \-]\d{3,4}|\d{3}[ \-]\d{3}[ \-]\d{4})(?!\d)|(?<!\d)\+\d{1,3}(?:[ \-]?\d{2,4}){3,5}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d])(?<!\d[ \-])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_NO_NAME}{_WORD}(?:[ \-]{_PARTICLES}{_NO_NAME}{_WORD})*+",
}
COMBINED = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold for any pattern to match: most texts end here.
HINT = rf"[0-9@]|(?i:key|token|secret|passw)|(?:{_TITLE})\.? \p{{Lu}}"
#: Collisions known to the plan as a literal up to this many, joined by text beyond it.
LITERAL_OVERRIDES = 2000
ROUNDS = 30


def _fits(kind: str, value: Column) -> Column:
    return value.rlike(rf"^(?:{PATTERNS[kind]})$")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of digits, every second one doubled, beginning at the given place from the right."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: let(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == doubled_from_right, 2).otherwise(1),
            lambda x: F.when(x > 9, x - 9).otherwise(x),
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _kind(match: Column) -> Column:
    """Type of a match; null for numbers that only look like a card's."""
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        test = _fits(kind, match)
        if kind == "card":
            test = test & (luhn_sum(_digits(match), 1) % 10 == 0)
        elif kind == "name":
            test = match.rlike(rf"^(?:{_TITLE})\.? ")
        out = F.when(test, F.lit(kind)).otherwise(out)
    return out


def _head(kind: Column, match: Column) -> Column:
    """The part of a match that stays: the words before a secret, the title before a name."""
    return (
        F.when(kind == "secret", F.regexp_extract(match, r"""^([^=:]*[=:]\s*(?:\\?["'])?)""", 1))
        .when(kind == "name", F.regexp_extract(match, rf"^((?:{_TITLE})\.? )", 1))
        .when(kind == "phone", F.regexp_extract(match, r"^(\+\d{1,3}(?=[ \-(])|)", 1))
        .otherwise(F.lit(""))
    )


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """128 hex digits from the key, the type, the value and the number of the attempt."""
    seed = lambda n: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(n), kind, attempt.cast("string"), value), 256)
    return F.concat(seed("1"), seed("2"))


def _byte(stream: Column, i) -> Column:
    at = F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(64)) * 2 + 1
    return F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int")


def _pick(words: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(n, F.lit(len(words))))


def _same_shape(value: Column, stream: Column) -> Column:
    """Digits become digits, small letters small letters, capitals capitals; all but letters and digits stays."""

    def swap(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(b, F.lit(26)) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), letter)
            .when(c.rlike(r"\p{Lu}"), F.upper(letter))
            .when(c.rlike(r"[\p{L}\p{N}]"), letter)
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _digits_from_right(value: Column, stream: Column) -> Column:
    """Digits become digits by their number from the right, so that separators and prefixes change none."""
    swap = lambda c, i: F.when(
        c.rlike("[0-9]"), F.pmod(_byte(stream, F.length(_digits(F.substring(value, i + 1, F.length(value))))), F.lit(10)).cast("string")
    ).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), swap), "")


def unit(kind: Column, value: Column) -> Column:
    """What all spellings of one value (a match without its head) have in common."""
    return F.when(kind.isin("card", "phone", "ssn"), _digits(value)).when(kind == "email", F.lower(value)).otherwise(value)


def _hex_shape(value: Column, stream: Column) -> Column:
    out = F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(stream, F.pmod(i, F.lit(128)) + 1, F.lit(1))), ""
    )
    return F.when(value.rlike("^[0-9A-F]+$"), F.upper(out)).otherwise(out)


def _card(value: Column, stream: Column) -> Column:
    """The first digit stays, the last one is the check digit again, separators keep their places."""
    digits = _digits(value)
    body = let(
        digits,
        lambda d: F.concat(
            F.substring(d, F.lit(1), F.lit(1)),
            F.array_join(
                F.transform(F.sequence(F.lit(2), F.length(d) - 1), lambda i: F.pmod(_byte(stream, i), F.lit(10)).cast("string")), ""
            ),
        ),
    )
    whole = let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))
    spaced = lambda w: F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(
                c.rlike("[0-9]"), F.substring(w, F.length(_digits(F.substring(value, F.lit(1), i + 1))), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )
    return let(whole, spaced)


def _family(syllables: list[str], stream: Column, attempt: Column) -> Column:
    """Each attempt has one syllable more, so that names never run out."""
    parts = F.transform(F.sequence(F.lit(1), attempt + 3), lambda i: _pick(syllables, _byte(stream, i)))
    return F.initcap(F.array_join(parts, ""))


def _title_is(match: Column, what: int) -> Column:
    """Gender (0) or script (1) of a name's title."""
    title = F.regexp_extract(match, rf"^({_TITLE})\.? ", 1)
    out = F.lit(None).cast("string")
    for key, titles in TITLES.items():
        out = F.when(title.isin(titles), F.lit(key[what])).otherwise(out)
    return out


def _family_part(value: Column) -> Column:
    return F.regexp_extract(value, r"([^ ]+)$", 1)


def _new_family(key: str, script: Column, family: Column, attempt: Column) -> Column:
    """The family name that takes the place of one, whatever the title and the given names."""
    out = F.lit(None).cast("string")

    def build(stream: Column) -> Column:
        made = out
        for name, syllables in SYLLABLES.items():
            made = F.when(script == name, _family(syllables, stream, attempt)).otherwise(made)
        return made

    return let(_stream(key, F.concat(F.lit("family "), script), family, attempt), build)


def _new_name(key: str, script: Column, gender: Column, value: Column, attempt: Column, family_attempt: Column) -> Column:
    """What takes the place of a name without its title. Later attempts have a second given name."""
    family = _new_family(key, script, _family_part(value), family_attempt)

    def build(stream: Column) -> Column:
        made = F.lit(None).cast("string")
        for (g, s), names in GIVEN.items():
            first = _pick(names, _byte(stream, 0))
            both = F.when(attempt > 0, F.concat_ws(" ", first, _family(SYLLABLES[s], stream, attempt))).otherwise(first)
            made = F.when((gender == g) & (script == s), both).otherwise(made)
        return made

    given = let(_stream(key, F.concat_ws(" ", F.lit("given"), script, gender), value, attempt), build)
    return F.when(value.contains(" "), F.concat_ws(" ", given, family)).otherwise(family)


#: Overrides are one number: the attempt, a hundred times the family's, ten thousand times the gender told by other titles.
GENDERS = ["", "f", "m"]


def _replaced(key: str, kind: Column, value: Column, unit: Column, attempt: Column) -> Column:
    """What takes the place of a value that is no name: seeded by its unit, in the form of this spelling."""

    def build(s: Column) -> Column:
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _byte(s, i).cast("string")), ".")
        email = F.concat(
            _same_shape(F.regexp_extract(value, r"^(.*)\.[^.]*$", 1), s), F.regexp_extract(value, r"(\.[^.]*)$", 1)
        )
        hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        return (
            F.when(kind == "secret", F.when(hexadecimal, _hex_shape(value, s)).otherwise(_same_shape(value, s)))
            .when(kind == "email", email)
            .when(kind == "ip", octets)
            .when(kind == "card", _card(value, s))
            .otherwise(_digits_from_right(value, s))
        )

    return let(_stream(key, kind, unit, attempt), build)


def surrogate(key: str, kind: Column, match: Column, override: Column) -> Column:
    """What takes the place of a match of the given type."""
    attempt = F.pmod(override, F.lit(100))

    def of(head: Column) -> Column:
        value = F.substring(match, F.length(head) + 1, F.length(match))
        told = F.get(F.array(*[F.lit(g) for g in GENDERS]), F.floor(override / 10000).cast("int"))
        gender = F.when(told == "", _title_is(match, 0)).otherwise(told)
        name = let(
            F.struct(_title_is(match, 1).alias("s"), gender.alias("g"), value.alias("v")),
            lambda n: _new_name(key, n["s"], n["g"], n["v"], attempt, F.pmod(F.floor(override / 100), F.lit(100)).cast("int")),
        )
        return F.concat(head, F.when(kind == "name", name).otherwise(_replaced(key, kind, value, unit(kind, value), attempt)))

    return let(_head(kind, match), of)


def _found(text: Column) -> Column:
    """All matches of a text, in order."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({COMBINED})"), F.lit(1))).otherwise(none)


def _values(matches: DataFrame) -> DataFrame:
    return matches.withColumn("kind", _kind(F.col("match"))).where("kind IS NOT NULL")


def _settled(units: DataFrame, real: DataFrame, new) -> DataFrame:
    """``units`` (space, unit and what ``new`` needs) with the first attempt that leaves no clash.

    ``new(attempt)`` must differ from that of every other unit of its space, and from every value in
    ``real`` (space, _s). Units that fail take the next attempt, until none fails.
    """
    columns = units.columns
    e = checkpointed(units.withColumn("attempt", F.lit(0)))
    real = real.distinct().withColumn("_real", F.lit(True))
    for _ in range(ROUNDS):
        s = e.withColumn("_s", new(F.col("attempt")))
        nth = F.row_number().over(Window.partitionBy("space", "_s").orderBy("attempt", "unit"))
        s = s.withColumn("_bad", nth > 1).join(real, ["space", "_s"], "left")
        s = s.withColumn("_bad", F.col("_bad") | F.coalesce("_real", F.lit(False)))
        s = checkpointed(s.select(*columns, (F.col("attempt") + F.col("_bad").cast("int")).alias("attempt"), "_bad"))
        e = s.drop("_bad")
        if s.where("_bad").isEmpty():
            return e
    raise RuntimeError("surrogates still collide: the space of one type is too small for its entities")


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """(match, override > 0) of the entities whose first surrogates would not do.

    A surrogate must differ from every surrogate and every real value of its type, whatever the spelling
    (separators of numbers, case of addresses, labels of secrets). Names are settled
    without their titles: first family names, apart in each script and from every word of a real name,
    then names with given names, whose gender a title without one takes from the others of that name.
    """
    e = checkpointed(entities.select("kind", "match").distinct())
    e = e.withColumn("head", _head(F.col("kind"), F.col("match")))
    value = F.expr("substring(match, length(head) + 1)")
    others = e.where("kind != 'name'").select("match", F.col("kind").alias("space"), unit(F.col("kind"), value).alias("unit"))
    units = others.select("space", "unit").distinct()
    moved = _settled(
        units, units.select("space", F.col("unit").alias("_s")), lambda a: _replaced(key, F.col("space"), F.col("unit"), F.col("unit"), a)
    ).where("attempt > 0")
    moved = others.join(moved, ["space", "unit"])

    names = e.where("kind = 'name'")
    names = names.select("match", _title_is(F.col("match"), 0).alias("own"), _title_is(F.col("match"), 1).alias("space"), value.alias("value"))
    names = names.withColumn("family", _family_part(F.col("value")))
    told = names.groupBy("space", "value").agg(F.max(F.col("own") == "f").alias("f"), F.max(F.col("own") == "m").alias("m"))
    names = names.join(told, ["space", "value"])
    names = names.withColumn(
        "gender", F.when((F.col("own") == "n") & (F.col("f") != F.col("m")), F.when(F.col("f"), "f").otherwise("m")).otherwise(F.col("own"))
    )
    names = checkpointed(names.select("match", "own", "gender", "space", "value", "family"))

    words = names.select("space", F.explode(F.concat(F.array("family"), F.split("value", r"[ \-]"))).alias("_s"))
    families = names.select("space", F.col("family").alias("unit")).distinct()
    families = _settled(families, words, lambda a: _new_family(key, F.col("space"), F.col("unit"), a))
    families = families.select("space", F.col("unit").alias("family"), F.col("attempt").alias("family_attempt"))
    names = names.join(families, ["space", "family"])

    full = names.where(F.col("value").contains(" "))
    persons = full.select("space", "gender", "value", "family_attempt", F.concat_ws(" ", "value", "gender").alias("unit")).distinct()
    persons = _settled(
        persons, full.select("space", F.col("value").alias("_s")),
        lambda a: _new_name(key, F.col("space"), F.col("gender"), F.col("value"), a, F.col("family_attempt")),
    ).select("space", "gender", "value", "attempt")
    names = names.join(persons, ["space", "gender", "value"], "left")
    gender = F.when((F.col("own") == F.col("gender")) | ~F.col("value").contains(" "), 0).when(F.col("gender") == "f", 1).otherwise(2)
    override = F.coalesce("attempt", F.lit(0)) + 100 * F.col("family_attempt") + 10000 * gender
    out = moved.select("match", F.col("attempt").alias("override"))
    return out.unionByName(names.select("match", override.cast("int").alias("override"))).where("override > 0")


def anonymised(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", literal_overrides: int = LITERAL_OVERRIDES
) -> DataFrame:
    """id, n_entities, kinds (sorted) and the text with surrogates, for every row of ``docs``.

    One value has one surrogate in the whole corpus, in the form of each of its spellings; different
    values have different ones, and no surrogate is another real value of the corpus. Surrogates depend on ``key`` and the value alone,
    but for those that collide, and given names after a title without gender. Names are one person's
    when they differ in their titles only, and equal family names stay equal. Null text gives the null text and no entities. Rows are
    handled one by one: repeated rows get equal texts; other columns are ignored; an empty table
    gives no rows.
    """
    private_names(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn(
        "_found", _found(F.coalesce("_text", F.lit("")))
    )
    entities = _values(rows.select(F.explode(F.array_distinct("_found")).alias("match")).distinct())
    bad = checkpointed(collisions(entities, key))
    if bad.count() <= literal_overrides:
        pairs = [F.lit(x) for r in bad.collect() for x in (r["match"], r["override"])]
        rows = rows.withColumn("_again", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,int>"))
    else:
        hashed = rows.withColumn("_digest", F.sha2(F.coalesce("_text", F.lit("")), 256))
        own = hashed.select("_digest", F.explode(F.array_distinct("_found")).alias("match")).distinct()
        own = own.join(bad.select("match", "override"), "match").groupBy("_digest").agg(
            F.map_from_entries(F.collect_list(F.struct("match", "override"))).alias("_again")
        )
        rows = hashed.join(own, "_digest", "left")
    typed = F.transform("_found", lambda m: F.struct(_kind(m).alias("kind"), m.alias("match")))
    rows = rows.withColumn("_typed", typed)
    new = F.transform(
        "_typed",
        lambda e: F.when(e["kind"].isNull(), e["match"]).otherwise(
            surrogate(key, e["kind"], e["match"], F.coalesce(F.try_element_at(F.col("_again"), e["match"]), F.lit(0)))
        ),
    )
    rows = rows.withColumn("_new", new)
    gaps = F.split("_text", COMBINED)
    # Gaps and matches alternate, and there is one gap more.
    text = F.concat_ws("", F.flatten(F.zip_with(gaps, "_new", lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))))
    real = F.filter("_typed", lambda e: e["kind"].isNotNull())
    return rows.select(
        F.col("_id").alias(id_col),
        F.size(real).cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct(F.transform(real, lambda e: e["kind"]))).alias("kinds"),
        F.when(F.size("_found") > 0, text).otherwise(F.col("_text")).alias("text"),
    )
