"""PII surrogates: keyed, type-consistent, distinct, and the same wherever an entity recurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.once import once
from meterline.llm.scratch import Scratch

# Short titles that are also common abbreviations do not stand before words in capitals.
MALE = r"Mr|Herr|Señor|(?:Sr|M)(?=\.? \p{Lu}['’\p{Ll}])|Monsieur|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|г-жа"
EITHER = "Dr|Prof"
# Words of a name: Berg, O'Neil, Jean-Luc, McLean; or all in capitals.
MIXED = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:['’-]?\p{Lu}\p{Ll}+|-\p{Ll}+)*"
UPPER = r"\p{Lu}['’]?\p{Lu}+(?:['’-]\p{Lu}{2,})*"
GROUP = "[0-9A-Fa-f]{1,4}"

# In order of precedence where two could start at one place.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?\"?(?=[_\-./+]*[A-Za-z0-9])[A-Za-z0-9_\-./+]{6,}\"?",
    "aws": r"\bAKIA[0-9A-Z]{16}\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "ip6": rf"\b(?=[0-9A-Fa-f:]*[0-9])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}})\b(?!:)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}\b",
    "name": rf"\b(?:{MALE}|{FEMALE}|{EITHER})\.? (?:{MIXED}(?: {MIXED})?|{UPPER}(?: {UPPER})?)",
}
ANY = "|".join(f"(?:{pattern})" for pattern in KINDS.values())

# Given names by script and gender, and syllables of made-up surnames.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carl Daniel Emil Felix Hugo Ivan Jonas Karim Leon Martin Nils Oscar Paul Robin",
    ("latin", "f"): "Alma Bianca Clara Diana Elena Fanny Greta Helena Irene Julia Karin Lina Maria Nora Olivia Paula",
    ("latin", "x"): "Alex Chris Dana Eli Jamie Kim Lee Luca Noel Pat Quinn Robin Sam Sasha Taylor Toni",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Фёдор",
    ("cyrillic", "f"): "Алина Вера Галина Дарья Елена Жанна Инна Кира Лидия Мария Нина Ольга Полина Раиса Софья Юлия",
    ("cyrillic", "x"): "Валя Женя Саша Слава Шура",
}
SYLLABLES = {
    "latin": "ba ce di fo gu ha jo ka le mi no pa ra so tu va".split(),
    "cyrillic": "ба ве ги до жу ка ло ми на пе ро са ту фи ха ше".split(),
}
# Country codes of one and two digits; all others have three.
COUNTRY = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|)"
NUMBERS = ("phone", "iban", "ssn", "card")
SIGN = "[0-9A-Z+]"  # what counts in a number; all else is its format
DIGITS, LOW, HIGH, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def kind_of(entity: Column) -> Column:
    """The kind whose pattern an entity is; a name also has its gender and script."""
    out = None
    for kind, pattern in KINDS.items():
        test = entity.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise(F.lit("other"))


def _drawn(key: str, *parts: Column) -> Column:
    """A number from 0 to 2^60, fixed by the key and the parts."""
    text = F.concat_ws("\u0001", F.lit(key), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _pick(members: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, members)), F.pmod(number, F.lit(len(members))).cast("int"))


def _shaped(text: Column, key: str, seed: Column, hexadecimal: Column) -> Column:
    """Digits become digits, letters letters of the same case; all else stays."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    fresh = F.transform(
        letters,
        lambda c, i: F.when(hexadecimal & c.rlike("[0-9a-f]"), F.substr(F.lit(HEX), F.pmod(_drawn(key, seed, i), F.lit(16)).cast("int") + 1, F.lit(1)))
        .when(c.rlike("[0-9]"), F.substr(F.lit(DIGITS), F.pmod(_drawn(key, seed, i), F.lit(10)).cast("int") + 1, F.lit(1)))
        .when(c.rlike("[a-z]"), F.substr(F.lit(LOW), F.pmod(_drawn(key, seed, i), F.lit(26)).cast("int") + 1, F.lit(1)))
        .when(c.rlike("[A-Z]"), F.substr(F.lit(HIGH), F.pmod(_drawn(key, seed, i), F.lit(26)).cast("int") + 1, F.lit(1)))
        .otherwise(c),
    )
    return F.array_join(fresh, "")


def _luhn(number: Column) -> Column:
    """``number`` (digits, perhaps spaced) with its last digit made a valid check digit."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    digits = F.filter(digits, lambda c: c != "")
    tail = F.slice(digits, F.lit(2), F.size(digits))
    worth = F.transform(tail, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(worth, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    check = F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))
    return F.concat(F.substr(number, F.lit(1), F.length(number) - 1), check.cast("string"))


HEAD = r"^([A-Za-z_-]+\s?[=:]\s?\"?)"  # what leads a secret


def family_of(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def gender_of(name: Column) -> Column:
    """What the title of a name says: f, m, or null for titles of either."""
    title = F.substring_index(name, " ", 1)
    return F.when(title.rlike(f"^(?:{FEMALE})\\.?$"), "f").when(~title.rlike(f"^(?:{EITHER})\\.?$"), "m")


def secret_value(entity: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(entity, HEAD, ""), '"$', "")


def whole_address(entity: Column) -> Column:
    """The eight groups of an IPv6 address, lower-case, without leading zeros."""
    groups = lambda text: F.transform(F.filter(F.split(F.lower(text), ":"), lambda g: g != ""), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    low, high = groups(F.substring_index(entity, "::", 1)), groups(F.substring_index(entity, "::", -1))
    short = F.concat(low, F.array_repeat(F.lit("0"), F.lit(8) - F.size(low) - F.size(high)), high)
    return F.array_join(F.when(entity.contains("::"), short).otherwise(low), ":")


def parts_of(kind: Column, entity: Column, gender: Column) -> Column:
    """What an entity is told by: an array of (kind, within, norm).

    Numbers go without their format, mail addresses by their domain in lower case, secrets by
    their value, IPv6 addresses by all groups. A name is its family name, and a given name
    within family and gender, in lower case, so the title's spelling says nothing.
    """
    part = lambda kind, within, norm: F.struct(kind.alias("kind"), within.alias("within"), norm.alias("norm"))
    words = F.split(F.lower(entity), " ")
    family = F.element_at(words, -1)
    names = F.array(part(F.lit("family"), F.lit(""), family))
    both = F.concat(names, F.array(part(F.lit("given"), F.concat_ws(" ", gender, family), F.get(words, 1))))
    norm = (
        F.when(kind.isin(*NUMBERS), F.regexp_replace(entity, SIGN.replace("[", "[^"), ""))
        .when(kind == "email", F.concat(F.substring_index(entity, "@", 1), F.lit("@"), F.lower(F.substring_index(entity, "@", -1))))
        .when(kind == "secret", secret_value(entity)).when(kind == "ip6", whole_address(entity)).otherwise(entity)
    )
    return F.when(kind == "name", F.when(F.size(words) == 3, both).otherwise(names)).otherwise(F.array(part(kind, F.lit(""), norm)))


def surrogate(kind: Column, within: Column, norm: Column, attempt: Column, key: str) -> Column:
    """A replacement of the part's own type, fixed by key, part and attempt.

    From the third attempt on it grows by one sign for every two attempts, so no space
    is ever used up. (Addresses of four bytes cannot grow; theirs has 3.6e9.)
    """
    seed = F.concat_ws("\u0002", kind, within, norm, attempt.cast("string"))
    draw = lambda i: _drawn(key, seed, F.lit(f"n{i}"))
    no = F.lit(False)
    extra = F.floor(attempt / 2).cast("int")
    more = lambda sign, hexadecimal=no: _shaped(F.repeat(F.lit(sign), extra), key, F.concat(seed, F.lit("x")), hexadecimal)
    email = F.concat(
        _shaped(F.substring_index(norm, "@", 1), key, seed, no), more("a"), F.lit("@"),
        _shaped(F.regexp_extract(norm, "@([^.]+)", 1), key, F.concat(seed, F.lit("d")), no), F.regexp_extract(norm, r"@[^.]+(\..*)$", 1),
    )
    is_hex = norm.rlike("^[0-9a-f]+$")
    secret = F.concat(_shaped(norm, key, seed, is_hex), more("a", is_hex))
    aws = F.concat(F.lit("AKIA"), _shaped(F.substr(norm, F.lit(5), F.lit(16)), key, seed, no), more("A"))
    ip = F.concat_ws(".", F.pmod(draw(0), F.lit(223)) + 1, *(F.pmod(draw(i), F.lit(254)) + 1 for i in (1, 2, 3)))
    # groups of zero stay, so a short form stays one; later attempts fill them from the end
    group = lambda g, i: F.when((g != "0") | (i >= F.lit(7) - extra), F.lower(F.conv((F.pmod(_drawn(key, seed, i), F.lit(65535)) + 1).cast("string"), 10, 16))).otherwise(g)
    ip6 = F.array_join(F.transform(F.split(norm, ":"), group), ":")
    code = F.regexp_extract(norm, COUNTRY, 1)
    phone = F.concat(code, _shaped(F.substr(norm, F.length(code) + 1, F.length(norm)), key, seed, no), more("0"))
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), _shaped(F.substr(norm, F.lit(3), F.length(norm)), key, seed, no), more("0"))
    first = F.substr(norm, F.lit(1), F.lit(1))
    card = _luhn(F.concat(first, _shaped(F.substr(norm, F.lit(2), F.length(norm)), key, seed, no), more("0")))
    cyrillic = norm.rlike(r"\p{IsCyrillic}")
    word = lambda script, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(SYLLABLES[script], _drawn(key, seed, i))), "")
    family = F.when(cyrillic, word("cyrillic", extra + 4)).otherwise(word("latin", extra + 4))
    drawn = lambda script, gender: F.lower(_pick(GIVEN[script, gender].split(), draw(1)))
    names = lambda script: F.when(within.startswith("f "), drawn(script, "f")).when(within.startswith("m "), drawn(script, "m")).otherwise(drawn(script, "x"))
    tail = lambda script: F.when(extra > 0, word(script, F.greatest(extra, F.lit(1)))).otherwise("")
    given = F.when(cyrillic, F.concat(names("cyrillic"), tail("cyrillic"))).otherwise(F.concat(names("latin"), tail("latin")))
    out = (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "aws", aws).when(kind == "ip", ip).when(kind == "ip6", ip6)
        .when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "card", card)
        .when(kind == "family", family).when(kind == "given", given)
    )
    return out.otherwise(F.concat(_shaped(norm, key, seed, no), more("0")))


def rendered(kind: Column, entity: Column, main: Column, given: Column) -> Column:
    """A part's surrogate in the format of the entity; what a number has grown by stands last."""
    letters = F.filter(F.split(entity, ""), lambda c: c != "")
    count = lambda text: F.length(F.regexp_replace(text, SIGN.replace("[", "[^"), ""))
    filled = F.transform(letters, lambda c, i: F.when(c.rlike(SIGN), F.substr(main, count(F.substr(entity, F.lit(1), i + 1)), F.lit(1))).otherwise(c))
    number = F.concat(F.array_join(filled, ""), F.substr(main, count(entity) + 1, F.length(main)))
    family = family_of(entity)
    styled = lambda part: F.when(family == F.upper(family), F.upper(part)).otherwise(F.initcap(part))
    name = F.concat_ws(" ", F.substring_index(entity, " ", 1), styled(given), styled(main))  # null parts are left out
    secret = F.concat(F.regexp_extract(entity, HEAD, 1), main, F.regexp_extract(entity, '("?)$', 1))
    groups = F.split(main, ":")
    low, high = (F.size(F.split(F.substring_index(entity, "::", n), ":")) for n in (1, -1))
    hidden = F.slice(groups, low + 1, F.lit(8) - low - high)
    short = F.concat(F.array_join(F.slice(groups, F.lit(1), low), ":"), F.lit("::"), F.array_join(F.slice(groups, F.lit(9) - high, high), ":"))
    ip6 = F.when(entity.contains("::") & ~F.exists(hidden, lambda g: g != "0"), short).otherwise(main)
    ip6 = F.when(entity.rlike("[A-F]"), F.upper(ip6)).otherwise(ip6)
    return (
        F.when(kind.isin(*NUMBERS), number).when(kind == "name", name).when(kind == "secret", secret).when(kind == "ip6", ip6).otherwise(main)
    )


def with_untitled(names: Column) -> Column:
    """The pattern of all entities of a document that has ``names`` behind titles.

    Once a title has shown a name, the name without it, or its family name alone, is an
    entity too, in any spelling that begins with a capital.
    """
    tails = F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(F.lower(F.regexp_replace(n, "^[^ ]+ ", "")), F.lower(family_of(n))))))
    longest_first = F.transform(F.array_sort(F.transform(tails, lambda t: F.struct(-F.length(t), t.alias("t")))), lambda x: x["t"])
    untitled = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?iu:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(names) > 0, untitled).otherwise(F.lit(ANY))


def drawn_parts(parts: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """(kind, within, norm, surrogate): distinct surrogates, none of which is itself a part.

    Parts whose surrogate collides with another's (all but the least), or with any
    part, draw again until none is left. Each round works on the collisions alone.
    Family names are told from family names, given names inside their family.
    """
    space = F.when(F.col("kind").isin("family", "given"), F.concat_ws(" ", "kind", "within")).otherwise("").alias("space")
    known = scratch.table(parts)
    draw = lambda df: df.withColumn("surrogate", surrogate(*map(F.col, ("kind", "within", "norm", "attempt")), key))
    done, open_rows, attempt = None, draw(known.withColumn("attempt", F.lit(0))), 0
    while True:
        open_rows = scratch.table(open_rows)
        taken = known.select(space, F.col("norm").alias("surrogate"))
        taken = taken if done is None else taken.unionByName(done.select(space, "surrogate"))
        free = open_rows.select("*", space).join(taken.distinct(), ["space", "surrogate"], "left_anti")
        first = free.groupBy("space", "surrogate").agg(F.min(F.struct("norm", "kind", "within")).alias("least"))
        fine = first.select("least.kind", "least.within", "least.norm", "surrogate")
        done = scratch.table(fine if done is None else done.unionByName(fine))
        rest = open_rows.join(done.drop("surrogate"), ["kind", "within", "norm"], "left_anti").select("kind", "within", "norm")
        attempt += 1
        open_rows = draw(rest.withColumn("attempt", F.lit(attempt)))
        if rest.isEmpty():
            return done


def assigned(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """(kind, entity, surrogate): mentions of one entity get one surrogate, each in its own format."""
    # a title of either gender takes what another title says of the same name
    name = F.when(F.col("kind") == "name", F.lower(F.regexp_replace("entity", "^[^ ]+ ", ""))).otherwise(F.col("entity"))
    gender = F.coalesce(gender_of(F.col("entity")), F.min(gender_of(F.col("entity"))).over(Window.partitionBy("kind", name)), F.lit("x"))
    known = scratch.table(entities.withColumn("gender", gender).withColumn("parts", parts_of(*map(F.col, ("kind", "entity", "gender")))).drop("gender"))
    done = drawn_parts(known.select(F.explode("parts").alias("p")).select("p.*").distinct(), scratch, key)
    told = done.select(F.struct("kind", "within", "norm").alias("part"), "surrogate")
    rows = known.select("kind", "entity", F.get("parts", 0).alias("main"), F.get("parts", 1).alias("given"))
    rows = rows.join(told.withColumnsRenamed({"part": "main", "surrogate": "x"}), "main")
    rows = rows.join(told.withColumnsRenamed({"part": "given", "surrogate": "y"}), "given", "left")
    return scratch.table(rows.select("kind", "entity", rendered(*map(F.col, ("kind", "entity", "x", "y"))).alias("surrogate")))


def pseudonymised(docs: DataFrame, scratch: Scratch, *, key: str) -> DataFrame:
    """(doc_id, n_entities, text) for every row of ``docs``: entities replaced by surrogates.

    Entities are matched by ``KINDS``: addresses, secrets, keys, numbers, and names
    behind a title, which gives the gender; the script is the name's own. A name so found
    is replaced in the same document without its title too (see ``with_untitled``). An entity
    has one surrogate in all documents, different ones have different ones: numbers are
    told by their signs without the format, names by family and given name (see ``parts_of``).

    Detection, drawing and replacing are built-in expressions. Only distinct entities
    are drawn for and joined; a hot entity is counted before its shuffle and its rows
    are split by the sort-merge join. A null text stays null, with 0 entities. Equal
    rows get equal results. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    copy = F.xxhash64("text").alias("copy")
    titled = lambda found: F.array_sort(F.array_distinct(F.filter(found, lambda e: e.rlike(f"^(?:{KINDS['name']})$"))))
    first = docs.select("doc_id", copy, "text", once(F.regexp_extract_all("text", F.lit(ANY), 0), "found")).where("size(found) > 0")
    first = first.select("*", once(titled(F.col("found")), "names"))
    again = F.when(F.size("names") > 0, F.regexp_extract_all("text", with_untitled(F.col("names")), 0)).otherwise(F.col("found"))
    shown = first.select("doc_id", "copy", "names", F.posexplode(again).alias("pos", "mention"))
    # an untitled mention goes by the name whose end it is
    owner = F.array_min(F.filter("names", lambda n: F.lower(n).endswith(F.concat(F.lit(" "), F.lower("mention")))))
    owner = F.when(~F.array_contains("names", F.col("mention")), owner)
    flat = scratch.table(shown.select("doc_id", "copy", "pos", "mention", F.coalesce(owner, F.col("mention")).alias("entity"), owner.isNotNull().alias("bare")))
    names = assigned(flat.select("entity").distinct().select(kind_of(F.col("entity")).alias("kind"), "entity"), scratch, key)
    count = F.size(F.split("mention", " "))
    words = F.split("surrogate", " ")
    ending = F.initcap(F.array_join(F.slice(words, F.size(words) - count + 1, count), " "))
    ending = F.when(F.col("mention") == F.upper("mention"), F.upper(ending)).otherwise(ending)
    told = flat.join(names, "entity").withColumn("surrogate", F.when(F.col("bare"), ending).otherwise(F.col("surrogate")))
    by_doc = told.groupBy("doc_id", "copy").agg(
        F.sort_array(F.collect_set(F.struct("pos", "surrogate"))).alias("told"),
        F.array_sort(F.collect_set(F.when(F.expr("kind = 'name' and not bare"), F.col("entity")))).alias("names"),
    )
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), F.col("told.surrogate").alias("told"), "names")
    rows = docs.select("doc_id", "text", copy)
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
    parts = F.split("text", with_untitled(F.col("names")), -1)
    woven = F.zip_with(parts, "told", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return joined.select(
        "doc_id",
        F.when(F.col("told").isNull(), 0).otherwise(F.size("told")).cast("long").alias("n_entities"),
        F.when(F.col("told").isNull(), F.col("text")).otherwise(F.array_join(woven, "")).alias("text"),
    )
