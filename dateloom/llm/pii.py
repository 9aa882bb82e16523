"""Personal data replaced by keyed surrogates of the same type and format.

One pattern finds mail and IP addresses, card, phone, social-security and bank
numbers, access keys and passwords, and names of persons (by title or given
name). Each becomes one unit or, for names, one unit a word; a unit's surrogate
is drawn from the SHA-512 of (key, type, canonical form, attempt), so the same
person or number reads alike in every document and every spelling. Names keep
script and gender, numbers keep their grouping, first digit and check digit,
addresses their shape, letters their case and script. A person named with a title
once is replaced where the same two names stand without it in that text.

A unit is its type and canonical form. The gender of a given name is no part of it:
it is the one the fixed list gives, else the one of all titles the name stands with
anywhere, or neither where they differ, so "Mr. Alex" and "Dr. Alex" are one unit.

Distinct units must stay distinct: the table of units is searched for surrogates
drawn twice by units of one type, or equal to a real unit of it, and those units draw
again until none is left. Redrawn names are made of ever more syllables of their
script, and after ``FORMAT_ATTEMPTS`` redraws a number or address grows by a digit
with each, so there is a free surrogate for any number of units. Only redrawn units
and given names whose gender is known from titles have to be looked up again; every other
surrogate is computed where the text is. All of it is DataFrame operations.

Edge cases: null texts stay null and empty ones empty; digits that fail their
checksum, or are no address, stay as they are; ids play no part, so null and repeated
ones are as any other; repeated rows each get their text; an empty table gives an
empty result; other columns pass through ``pseudonymize`` untouched, but for an
older ``n_entities``, which is replaced.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateloom.llm.common import fresh, let, materialize, text_or_empty

#: Session setting that names the secret key of the surrogates.
KEY_SETTING = "dateloom.surrogate.key"
#: Redraws that keep a number's, address's or secret's format to the digit; each later one adds a digit.
FORMAT_ATTEMPTS = 24
#: Consonants and vowels of the syllables of redrawn names, and their endings by gender.
SYLLABLES: dict[str, tuple[str, str, dict[str, str]]] = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"f": "na", "m": "rd", "n": "l"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"f": "на", "m": "рд", "n": "ль"}),
    "greek": ("βγδζκλμνπρστφ", "αεηιο", {"f": "να", "m": "νος", "n": "λι"}),
}

#: Given and family names by script; genders f, m. Fixed values.
GIVEN: dict[str, list[str]] = {
    "latin_f": "Alice Clara Diana Elena Fiona Hanna Irene Julia Laura Maria Nina Paula Rosa Sofia Teresa Vera".split(),
    "latin_m": "Adam Bruno Carl David Erik Frank Georg Hugo Ivan Jonas Karl Leon Martin Oscar Paul Simon".split(),
    "cyrillic_f": "Анна Вера Галина Дарья Елена Ирина Мария Ольга".split(),
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Иван Олег Павел".split(),
    "greek_f": "Άννα Ελένη Ειρήνη Μαρία Σοφία Ζωή Δήμητρα Κατερίνα".split(),
    "greek_m": "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σταύρος Ανδρέας Μάριος".split(),
}
FAMILY: dict[str, list[str]] = {
    "latin": (
        "Abbott Bauer Becker Castillo Dumont Ekberg Fischer Garnier Hartley Ibsen Jansen Keller Lambert Moreno Norris "
        "Olsen Parker Quintero Ramos Sanders Thorne Ullman Vargas Weber Young Zeller"
    ).split(),
    "cyrillic": "Белов Волков Громов Дроздов Ершов Зимин Козлов Лунин Морозов Носов Панин Седов".split(),
    "greek": "Αλεξίου Βασιλείου Γεωργίου Δήμου Ιωάννου Καρράς Λάμπρου Μανής Νικολάου Παππάς Ρήγας Στεφάνου".split(),
}
#: Titles by gender (n: either). Fixed values.
TITLES: dict[str, list[str]] = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа Κυρία".split(),
    "m": "Mr Herr Monsieur Señor Sr Господин Κύριος".split(),
    "n": "Dr Prof".split(),
}

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(n for ns in GIVEN.values() for n in ns)
#: All titles and given names begin so; tested first, since most letters do not.
_INITIALS = r"(?=[A-Z\u0370-\u04FF])"
_WORD = r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)*"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NEXT = rf"(?!(?:{_TITLE})(?![\p{{L}}])){_WORD}"
_PERSON = rf"(?:(?:{_TITLE})\.? {_NEXT}(?: {_NEXT})?|(?:{_GIVEN}) {_NEXT})"
#: Tried in this order at each position.
PATTERN = "|".join(
    [
        r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
        rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
        r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|(?:sk|ghp|gho|xoxb|xoxp)[_\-][0-9A-Za-z_\-]{16,})(?![\p{L}\p{N}])",
        r"(?<=(?:password|passwd|secret|api_key|apikey|token)[=:])[^\s\"']{6,}",
        r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
        r"(?<![0-9])(?:[0-9]{4}[ \-]){3}[0-9]{4}(?![0-9])",
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
        r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])",
        r"(?<![0-9+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])",
        r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9]{1,3})?(?![\p{L}\p{N}])",
        rf"{_INITIALS}(?<![\p{{L}}\p{{N}}]){_PERSON}(?![\p{{L}}\p{{N}}])",
    ]
)
#: What every match of the pattern holds; most texts hold none of it and are not searched further.
SIGNAL = (
    r"[0-9@]|AKIA|(?:sk|ghp|gho|xoxb|xoxp)[_\-]|(?:password|passwd|secret|api_key|apikey|token)[=:]|[a-f]{32}"
    rf"|{_INITIALS}(?:{_TITLE}|{_GIVEN})(?!\p{{L}})"
)
#: Stands around each match in a marked text; texts that hold it themselves are searched twice instead.
MARK = "\x01"


def pieces_of(text: Column) -> Column:
    """A text as [gap, match, gap, match, ..., gap]: the pattern runs over it once. Null where nothing is found."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    gaps, matches = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    woven = F.flatten(F.zip_with(gaps, matches, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    found = F.when(F.contains(text, F.lit(MARK)), woven).otherwise(marked)
    return F.when(text.rlike(SIGNAL), F.get(F.transform(F.array(found), lambda p: F.when(F.size(p) > 1, p)), 0))


def matches_in(text: Column) -> Column:
    """All matches of a text."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(SIGNAL), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def characters(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def luhn_sum(digits: Column) -> Column:
    """The checksum total of a digit string, the last digit counting once."""
    back = F.reverse(digits)
    steps = F.transform(
        characters(back),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def entity_type(e: Column) -> Column:
    """The type of a match; ``none`` for digits that only look like a card."""
    return (
        F.when(F.contains(e, F.lit("@")), "mail")
        .when(e.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip")
        .when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(
            e.rlike(r"^(?:[0-9]{13,19}|(?:[0-9]{4}[ \-]){3}[0-9]{4})$"),
            F.when(luhn_sum(digits_of(e)) % 10 == 0, "card").otherwise("none"),
        )
        .when(e.rlike(r"^[+(]"), "phone")
        .when(e.rlike(rf"^{_PERSON}$"), "person")
        .when(e.rlike(r"^[A-Z]{2}[0-9]{2}[ 0-9A-Z]+$"), "iban")
        .otherwise("secret")
    )


def canonical(kind: Column, e: Column) -> Column:
    return (
        F.when(kind.isin("ssn", "card", "phone"), digits_of(e))
        .when(kind.isin("mail"), F.lower(e))
        .when(kind == "iban", F.translate(e, " ", ""))
        .otherwise(e)
    )


def script_of(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def name_words(e: Column) -> Column:
    """The name without its title."""
    return F.split(F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", ""), " ")


WOMEN = sorted(n for k, ns in GIVEN.items() if k.endswith("_f") for n in ns)
MEN = sorted(n for k, ns in GIVEN.items() if k.endswith("_m") for n in ns)


def listed_gender(canon: Column) -> Column:
    """The gender that the list of given names says; null for other names."""
    women, men = ([n.lower() for n in names] for names in (WOMEN, MEN))
    return F.when(canon.isin(women), "f").when(canon.isin(men), "m")


def title_gender(e: Column) -> Column:
    """The gender of a match's title; null without one, or with one of either gender."""
    title = F.regexp_extract(e, rf"^({_TITLE})\.? ", 1)
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m")


UNIT = "struct<kind:string,canon:string>"


def unit(kind: Column, canon: Column) -> Column:
    return F.struct(kind.alias("kind"), canon.alias("canon"))


def units_of(e: Column) -> Column:
    """The units of one match: given and family name of a person, else the match itself; none for ``none``."""
    kind, words = entity_type(e), name_words(e)
    script = script_of(F.get(words, 0))
    given = unit(F.concat(F.lit("given_"), script), F.lower(F.get(words, 0)))
    family = unit(F.concat(F.lit("family_"), script), F.lower(F.get(words, F.size(words) - 1)))
    none = F.array().cast(f"array<{UNIT}>")
    return (
        F.when(kind == "none", none)
        .when(kind == "person", F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family)))
        .otherwise(F.array(unit(kind, canonical(kind, e))))
    )


def stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits drawn for the unit."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 512)


def by_name(rows: dict[str, str], name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in rows.items() for x in pair)), name)


#: Names to draw from, and endings, by kind and gender; letters of syllables by script.
DRAWN_NAMES = {f"family_{s}|{g}": " ".join(names) for s, names in FAMILY.items() for g in "fmn"}
DRAWN_NAMES |= {f"given_{s}|{g}": " ".join(n for x in ("fm" if g == "n" else g) for n in GIVEN[f"{s}_{x}"]) for s in FAMILY for g in "fmn"}
CONSONANTS, VOWELS = {s: c for s, (c, _, _) in SYLLABLES.items()}, {s: v for s, (_, v, _) in SYLLABLES.items()}
ENDINGS = {f"{s}|{g}": end for s, (_, _, ends) in SYLLABLES.items() for g, end in ends.items()}


def drawn_number(drawn: Column, at: Column | int, below: Column) -> Column:
    return F.conv(F.substr(drawn, F.lit(at) if isinstance(at, int) else at, F.lit(6)), 16, 10).cast("int") % below


def drawn_name(kind: Column, gender: Column, drawn: Column, attempt: Column) -> Column:
    """A name of the list at first; with each redraw one of a syllable more, ending by gender."""
    script = F.substring_index(kind, "_", -1)

    def syllable(i: Column) -> Column:
        one = lambda letters, at: F.substr(letters, drawn_number(drawn, at, F.length(letters)) + 1, F.lit(1))
        return F.concat(one(by_name(CONSONANTS, script), i * 12 % 120 + 1), one(by_name(VOWELS, script), i * 12 % 120 + 7))

    made = F.concat(
        F.array_join(F.transform(F.sequence(F.lit(1), attempt + 2), syllable), ""), by_name(ENDINGS, F.concat(script, F.lit("|"), gender))
    )
    listed = F.split(by_name(DRAWN_NAMES, F.concat(kind, F.lit("|"), gender)), " ")
    return F.when(attempt == 0, let(listed, lambda names: F.get(names, drawn_number(drawn, 1, F.size(names))))).otherwise(F.initcap(made))


def decimal(drawn: Column) -> Column:
    return F.translate(drawn, "abcdef", "370628")


def drawn_characters(text: Column, drawn: Column) -> Column:
    """Each letter and digit replaced by one of its script and case, everything else kept."""
    numbers, latin = decimal(drawn), F.translate(drawn, "0123456789abcdef", "bcdfghjklmnpqrst")
    cyrillic = F.translate(drawn, "0123456789abcdef", "абвгдежзиклмнопр")
    greek = F.translate(drawn, "0123456789abcdef", "αβγδεζηθικλμνξοπ")

    def swap(c: Column, i: Column) -> Column:
        at = i % 128 + 1
        one = lambda s: F.substr(s, at, F.lit(1))
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), one(cyrillic)).when(c.rlike(r"\p{IsGreek}"), one(greek)).otherwise(one(latin))
        return (
            F.when(c.rlike(r"[0-9]"), one(numbers))
            .when(c.rlike(r"\p{Lu}"), F.upper(letter))
            .when(c.rlike(r"\p{L}"), letter)
            .otherwise(c)
        )

    return F.array_join(F.transform(characters(text), swap), "")


def checked(body: Column) -> Column:
    """The digits with a last one that makes the checksum right."""
    return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def surrogate(kind: Column, canon: Column, attempt: Column, gender: Column, key: str) -> Column:
    """The surrogate of a unit in canonical form. ``gender`` counts for given names alone."""
    return let(stream(kind, canon, attempt, key), lambda drawn: surrogate_of(kind, canon, attempt, gender, drawn))


def surrogate_of(kind: Column, canon: Column, attempt: Column, gender: Column, drawn: Column) -> Column:
    size = F.length(canon)
    numbers = F.substr(decimal(drawn), F.lit(1), size)
    same_first = F.concat(F.substring(canon, 1, 1), F.substr(numbers, F.lit(2), size))
    octet = lambda at: (F.conv(F.substring(drawn, at, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    # What is drawn letter by letter, after a part that stays: the ending of an address is added behind.
    stays = F.when(kind == "iban", 2).when((kind == "secret") & canon.rlike("^AKIA"), 4).otherwise(0)
    host = F.substring_index(canon, "@", -1)
    spelled = F.when(kind == "mail", F.concat(F.substring_index(canon, "@", 1), F.lit("@"), F.substring_index(host, ".", 1))).otherwise(
        F.substr(canon, stays + 1)
    )
    ending = let(F.regexp_extract(host, r"\.(com|org|net)$", 1), lambda x: F.concat(F.lit(".example."), F.when(x == "", "org").otherwise(x)))
    letters = F.concat(F.substr(canon, F.lit(1), stays), drawn_characters(spelled, drawn), F.when(kind == "mail", ending).otherwise(""))
    value = (
        F.when(kind.rlike("^(given|family)_"), drawn_name(kind, gender, drawn, attempt))
        .when(kind == "ip", F.concat_ws(".", octet(1), octet(5), octet(9), octet(13)))
        .when(kind == "card", checked(F.substr(same_first, F.lit(1), size - 1)))
        .when(kind.isin("phone", "ssn"), same_first)
        .when((kind == "secret") & canon.rlike("^[0-9a-f]{1,640}$"), F.substr(F.repeat(drawn, 5), F.lit(1), size))
        .otherwise(letters)
    )
    more = F.substr(decimal(drawn), F.lit(1), attempt - FORMAT_ATTEMPTS)
    grown = lambda x: F.when(kind == "mail", F.concat(more, x)).otherwise(F.concat(x, more))
    as_it_is = (attempt <= FORMAT_ATTEMPTS) | kind.rlike("^(given|family)_")
    return let(value, lambda x: F.when(as_it_is, x).otherwise(grown(x)))


def in_format(e: Column, drawn: Column, kept: str) -> Column:
    """The characters of ``drawn`` in place of those of ``e``, except those of the class ``kept``, which stay; what is left of it last."""
    seen = lambda i: F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), kept, ""))
    swapped = F.transform(characters(e), lambda c, i: F.when(c.rlike(kept), c).otherwise(F.substr(drawn, seen(i), F.lit(1))))
    return F.concat(F.array_join(swapped, ""), F.substr(drawn, F.length(F.regexp_replace(e, kept, "")) + 1))


#: How an attempt and a gender stand in the map of looked-up units: attempt * 3 + the gender's place here.
GENDERS = ("n", "f", "m")


def unit_code(attempt: Column, gender: Column) -> Column:
    return (attempt * 3 + F.when(gender == "f", 1).when(gender == "m", 2).otherwise(0)).cast("int")


def unit_surrogate(u: Column, looked_up: Column, key: str) -> Column:
    """The surrogate of a unit. ``looked_up``: map of "kind|canon" to ``unit_code`` for units that need it."""

    def with_code(code: Column) -> Column:
        listed = F.coalesce(listed_gender(u["canon"]), F.lit("n"))
        gender = F.when(code.isNull() | (code % 3 == 0), listed).when(code % 3 == 1, "f").otherwise("m")
        return surrogate(u["kind"], u["canon"], F.coalesce(F.floor(code / 3), F.lit(0)).cast("int"), gender, key)

    code = F.try_element_at(looked_up, F.concat_ws("|", u["kind"], u["canon"]))
    return F.get(F.transform(F.array(code), with_code), 0)


def replacement(e: Column, looked_up: Column, key: str) -> Column:
    """What a match becomes."""

    def written(units: Column) -> Column:
        values = F.transform(units, lambda u: unit_surrogate(u, looked_up, key))
        kind, first = F.get(units, 0)["kind"], F.get(values, 0)
        title = F.regexp_extract(e, rf"^(?:{_TITLE})\.? ", 0)
        return (
            F.when(F.size(units) == 0, e)
            .when(kind.isin("ssn", "card", "phone"), in_format(e, first, "[^0-9]"))
            .when(kind.rlike("^(given|family)_"), F.concat(title, F.array_join(values, " ")))
            .when(kind == "iban", in_format(e, first, " "))
            .otherwise(first)
        )

    return F.get(F.transform(F.array(units_of(e)), written), 0)


def redraw(units: DataFrame, key: str) -> DataFrame:
    """(kind, canon, gender, attempt) of all units, with the first attempt whose surrogate is free.

    Of units that draw the same surrogate the first in order keeps it; a surrogate
    equal to a real unit of its kind is free for nobody. Units are drawn until all
    have one, as there are ever more.
    """
    gender = F.coalesce("gender", F.lit("n"))
    value = F.lower(surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), gender, key)).alias("value")
    state = materialize(units.select("kind", "canon", "gender", F.lit(0).alias("attempt")).select("*", value), "pii-attempts")
    while True:
        keeper = state.groupBy("kind", "value").agg(F.min_by("canon", F.struct("attempt", "canon")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        taken = keeper.where(F.col("n") > 1).select("kind", "value", "keeper")
        real = state.select("kind", F.col("canon").alias("value"), F.lit(True).alias("real"))
        marked = state.join(taken, ["kind", "value"], "left").join(real, ["kind", "value"], "left")
        again = F.coalesce((F.col("keeper") != F.col("canon")) | F.col("real"), F.lit(False)).alias("again")
        marked = materialize(marked.select("kind", "canon", "gender", "attempt", "value", again), "pii-marked")
        if not marked.where("again").take(1):
            return marked.select("kind", "canon", "gender", "attempt")
        moved = marked.where("again").select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt")).select("*", value)
        state = materialize(marked.where(~F.col("again")).drop("again").unionByName(moved), "pii-attempts")


def gendered_units(mentions: DataFrame) -> DataFrame:
    """(kind, canon, gender, listed) of all units: a given name's gender is the listed one, else that of all its titles."""
    found = mentions.groupBy("kind", "canon").agg(F.min("title").alias("least"), F.max("title").alias("most"))
    given = F.col("kind").startswith("given_")
    listed = F.when(given, listed_gender(F.col("canon")))
    titled = F.when(given & (F.col("least") == F.col("most")), F.col("least"))
    return found.select("kind", "canon", F.coalesce(listed, titled).alias("gender"), listed.alias("listed"))


def session_key(spark: SparkSession) -> str:
    """The key set for the session; where there is none, a random one that holds for the session."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def full_names(pieces: Column, new: Column) -> Column:
    """array<struct(old, new)>: names of two words that stand with a title among the matches, and what became of them."""
    titled = rf"^(?:{_TITLE})\.? {_WORD} {_WORD}$"
    bare = lambda x: F.array_join(name_words(x), " ")
    both = F.zip_with(pieces, new, lambda a, b: F.when(a.rlike(titled), F.struct(bare(a).alias("old"), bare(b).alias("new"))))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten and a column ``n_entities``: how many matches were replaced.

    ``key`` is secret: who has it can tell which surrogate a known name has.
    """
    if not key:
        raise ValueError("surrogates need a key")
    whole = text_or_empty(text)
    mentions = materialize(
        docs.select(F.xxhash64(whole).alias("hash"), F.explode(F.array_distinct(matches_in(whole))).alias("e"))
        .select("hash", title_gender(F.col("e")).alias("title"), F.explode(units_of(F.col("e"))).alias("u"))
        .select("hash", "u.kind", "u.canon", F.when(F.col("u.kind").startswith("given_"), F.col("title")).alias("title"))
        .distinct(),
        "pii-mentions",
    )
    units = materialize(gendered_units(mentions), "pii-units")
    drawn = redraw(units.select("kind", "canon", "gender"), key)
    special = drawn.join(units.select("kind", "canon", "listed"), ["kind", "canon"]).where(
        (F.col("attempt") > 0) | ~F.col("gender").eqNullSafe(F.col("listed"))
    )
    special = materialize(special.select("kind", "canon", unit_code(F.col("attempt"), F.col("gender")).alias("code")), "pii-special")
    # Equal texts have equal units, so the text's hash is the key, and a clash of two texts joins two small maps.
    maps = materialize(
        mentions.select("hash", "kind", "canon")
        .distinct()
        .join(special, ["kind", "canon"])
        .groupBy("hash")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "code"))).alias("map")),
        "pii-by-text",
    )
    hashed, looked_up, found, new, names = (fresh(docs, n) for n in ("_hash", "_looked_up", "_pieces", "_new", "_names"))
    none = F.create_map().cast("map<string,int>")
    known = docs.withColumn(hashed, F.xxhash64(whole)).join(
        maps.select(F.col("hash").alias(f"{hashed}b"), F.col("map").alias(looked_up)), F.col(hashed) == F.col(f"{hashed}b"), "left"
    )
    known = known.withColumn(looked_up, F.coalesce(looked_up, none)).withColumn(found, pieces_of(whole))
    at_match = lambda i: i % 2 == 1
    changed = F.transform(found, lambda e, i: F.when(at_match(i), replacement(e, F.col(looked_up), key)).otherwise(e))
    entities = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))

    def without_title(gap: Column) -> Column:
        """Bare mentions of the persons that have a title elsewhere in the text."""

        def one(done: Column, name: Column) -> Column:
            pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), name["old"], F.lit(r"\E(?![\p{L}\p{N}])"))
            return F.when(F.contains(done, name["old"]), F.regexp_replace(done, pattern, name["new"])).otherwise(done)

        return F.aggregate(F.col(names), gap, one)

    rebuilt = F.when(F.size(names) == 0, F.col(new)).otherwise(F.transform(new, lambda p, i: F.when(at_match(i), p).otherwise(without_title(p))))
    return (
        known.withColumn(new, changed)
        .withColumn(names, full_names(F.col(found), F.col(new)))
        .withColumn("n_entities", F.coalesce(entities, F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col(found).isNotNull(), F.array_join(rebuilt, "")).otherwise(F.col(text)))
        .drop(hashed, f"{hashed}b", looked_up, found, new, names)
    )
