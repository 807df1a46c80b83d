"""PII by surrogate generation, in DataFrame functions only.

One expression finds the entities of a text: mail addresses, IPv4 addresses, phone numbers, card numbers, social security
numbers, bank account numbers, access keys, assigned secrets, and persons: a known given name or a title before a family
name, or two capitalised words after a salutation or a label (``CALLED``), or before a mail address in brackets. Each entity
has a kind and a normal form, which is the same however it is written (mail in lower case, numbers as digits, a person by the
family name). Mail domains, and given names that no list has, are entities of their own, so that they too have one surrogate.

The distinct normal forms of all texts get surrogates from a keyed hash, of the same type: digits for digits, letters of the
same script and case for letters (of listed alphabets, else of the letter's own 32 code points), valid octets, valid check
digits, given names of the same gender and script. Collision checks follow: two entities of a kind never share a surrogate
(mail: within a domain), and no surrogate is an entity of the corpus or its own original; what collides is drawn again, later
draws from a larger space (names and words one letter longer, octets of any length), so the draws end soon. An entity so has
one surrogate in all texts (coreference), and two entities have two (distinctness). Surrogates are then laid into each text
in the format of the place.

The key is the session's ``spark.frameloom.pii.secret``. Without it a random one is drawn for the session, so that nobody can
draw the table again; set it to have the same surrogates in several applications. It is a literal of the plans.

Texts without an entity pass through without a shuffle. Those with one are found once and kept in a checkpoint, from which
the entities and the new texts come.

Defined cases: a null text stays null; a text without entities, or empty, stays as it is; equal entities in a text, in
many texts or in repeated rows get one surrogate; equal texts get equal results; an empty table gives no rows; all columns
stay, whatever their names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import checkpointed, fresh

KEY_SETTING = "spark.frameloom.pii.secret"
ROUNDS = 64

#: Given names by script and gender, and titles.
GIVEN = {
    "latin_f": "Aisha Alice Amelie Ananya Anna Brigitte Carmen Charlotte Chiara Claire Elena Elizabeth Emma Fatima Giulia Hannah Ingrid Isabel Julia Karen Katarzyna Leila Linda Lucia Margaret Marie Martina Mary Monika Ngozi Nicole Olivia Patricia Petra Priya Sabine Sarah Sofia Susan Svetlana Teresa Ursula Yuki Zeynep".split(),
    "latin_m": "Ahmed Alexander Andreas Antonio Arjun Carlos Charles Christoph Daniel David Diego Dmitri Edward Felipe Fernando Georges Giovanni Hans Hassan Henri Hiroshi Jacques James Javier John Joseph Juan Kenji Klaus Kwame Luis Matthew Mehmet Michael Miguel Mohammed Muhammad Omar Pablo Peter Philippe Piotr Ravi Robert Thomas Vikram Wei William".split(),
    "cyrillic_f": "Анна Галина Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    "cyrillic_m": "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
    "greek_f": "Άννα Αικατερίνη Ελένη Κατερίνα Μαρία Σοφία".split(),
    "greek_m": "Γιώργος Γιάννης Δημήτρης Κώστας Νίκος Παναγιώτης".split(),
}
TITLES = "Mr Mrs Ms Dr Herr Frau Madame Monsieur Señor Señora Sr Sra Mme".split()

#: Words after which two capitalised words are a person.
CALLED = ("Dear", "Liebe", "Lieber", "Estimado", "Estimada", "Querido", "Querida", "Cher", "Chère", "Name:", "Author:", "Contact:", "Patient:", "Customer:", "Employee:", "Signed:", "Attn:", "name is")


def _any(words: list[str]) -> str:
    """One of the words, told apart by their first letters first."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{h}(?:{'|'.join(sorted(rest, key=lambda r: (-len(r), r)))})" for h, rest in heads.items())


_NAMES = _any([n for names in GIVEN.values() for n in names])
_TITLE = _any(TITLES)
_FAMILY = r"\p{Lu}\p{Ll}{1,30}(?:-\p{Lu}\p{Ll}{1,30})?"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
CARD = r"(?<![\d.-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
CLOUD = r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)"
HEX = r"(?<!\w)(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?!\w)"
SECRET = r"(?<=[=:] {0,2}[\"']?)(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey) {0,2}[=:] {0,2}[\"']?)[A-Za-z0-9_+/-]{6,}+"
_CALLED = "|".join(w.replace(" ", "[ ]") for w in CALLED)
PERSON = (
    rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? (?:{_FAMILY} )?{_FAMILY}|(?:{_NAMES}) {_FAMILY}"
    rf"|(?={_FAMILY} \p{{Lu}})(?:(?<=(?:{_CALLED})[ ]){_FAMILY} (?:\p{{Lu}}\. )?{_FAMILY}|{_FAMILY} {_FAMILY}(?= ?[<(][A-Za-z0-9._%+-]{{1,64}}@)))(?!\p{{L}})"
)
#: Alternatives behind the class of their first character, so that most places fail at once.
ENTITY = "|".join([EMAIL, SECRET, f"(?=[0-9(+])(?:{'|'.join([IP, CARD, PHONE, SSN])})", f"(?=\\p{{Lu}})(?:{'|'.join([IBAN, CLOUD, PERSON])})", HEX])
#: Any text with an entity has a digit, an at sign, one of these words, or a name or title; cheap tests before the full expression.
MARK = r"[0-9@]"
MARK_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
MARK_NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_NAMES}|{_TITLE}|{_any([c for c in CALLED if c[0].isupper()])})\.? |name is \p{{Lu}}"


def configured_key(spark: SparkSession) -> str:
    """The session's key; a random one for the session if none is set."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def _kind(e: Column) -> Column:
    whole = lambda p: e.rlike(rf"^(?:{p})$")
    return (
        F.when(e.contains("@"), "email").when(whole(IP), "ip").when(whole(CARD), "card").when(whole(PHONE), "phone").when(whole(SSN), "ssn").when(whole(CLOUD), "cloud").when(whole(HEX), "hex").when(e.rlike(r"^\p{Lu}[\p{L}-]*\.? \p{Lu}"), "person").when(whole(IBAN), "iban").otherwise("secret")
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _normal(kind: Column, e: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(e)).when(kind == "phone", F.substring(F.concat(F.lit("0" * 10), _digits(e)), -10, 10)).when(kind.isin("card", "ssn"), _digits(e)).when(kind == "iban", F.regexp_replace(e, " ", "")).when(kind == "person", F.lower(F.regexp_extract(e, r"(\S+)$", 1))).otherwise(e)
    )


def _draw(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


#: Alphabets; a letter is drawn from the alphabet that has it, so script, case and vowels stay.
_ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèùâêîôû", "äöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчш", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]


#: A letter of no alphabet is drawn from the 32 code points around it, among those of the same class.
_BLOCK = 32


def _neighbour(seed: Column, c: Column, i: Column) -> Column:
    code, start = F.ascii(c), _draw(seed, i, _BLOCK)
    near = F.transform(F.sequence(F.lit(0), F.lit(_BLOCK - 1)), lambda k: F.decode(F.unhex(F.lpad(F.hex(code - F.pmod(code, F.lit(_BLOCK)) + F.pmod(start + k, F.lit(_BLOCK))), 4, "0")), "UTF-16BE"))
    #: Letters with case must have one partner in the other, or capitals could not be laid over them.
    paired = lambda x, other: (F.length(other(x)) == 1) & (other(x) != x)
    same = lambda x: F.when(c.rlike(r"\p{Lu}"), x.rlike(r"\p{Lu}") & paired(x, F.lower)).when(c.rlike(r"\p{Ll}"), x.rlike(r"\p{Ll}") & paired(x, F.upper)).otherwise(x.rlike(r"\p{Lo}"))
    return F.when(c.rlike(r"\p{L}") & (code < 0x10000), F.coalesce(F.try_element_at(F.filter(near, same), F.lit(1)), c)).otherwise(c)


def _like(seed: Column, c: Column, i: Column, alphabets: list[str]) -> Column:
    out = _neighbour(seed, c, i) if alphabets is _ALPHABETS else c
    for a in reversed(alphabets):
        out = F.when(F.lit(a).contains(c), F.lit(a).substr(_draw(seed, i, len(a)) + 1, F.lit(1))).otherwise(out)
    return out


def _mapped(seed: Column, c: Column, alphabets: list[str] = _ALPHABETS) -> Column:
    return F.array_join(F.transform(_chars(c), lambda x, i: _like(seed, x, i, alphabets)), "")


def _luhn(digits: Column) -> Column:
    """The check digit that follows these digits."""
    each = F.transform(F.reverse(_chars(digits)), lambda x, i: F.when(i % 2 == 0, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(10)), F.lit(10)).cast("string")


def _mod97(c: Column) -> Column:
    """The remainder of an account number's digits, letters being 10 to 35."""
    step = lambda a, x: F.pmod(F.when(x.rlike("[0-9]"), a * 10 + F.ascii(x) - 48).otherwise(a * 100 + F.ascii(x) - 55), F.lit(97)).cast("int")
    return F.aggregate(_chars(c), F.lit(0), step)


def _iban(seed: Column, normal: Column) -> Column:
    """Country and form stay; check digits are right if they were, else they stay."""
    country, own = F.substring(normal, 1, 2), F.expr("substring(normal, 5, length(normal))")
    body = _mapped(seed, own)
    check = F.lpad((F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(_mod97(F.concat(own, country, F.substring(normal, 3, 2))) == 1, check).otherwise(F.substring(normal, 3, 2)), body)


def _surrogate(kind: Column, normal: Column, seed: Column, attempt: int) -> Column:
    """A draw for the entity; later attempts draw from a larger space."""
    wide = attempt >= 3
    octet = lambda o, i: F.when(F.lit(wide), _draw(seed, i, 254) + 1).when(F.length(o) == 1, _draw(seed, i, 9) + 1).when(F.length(o) == 2, _draw(seed, i, 90) + 10).otherwise(_draw(seed, i, 155) + 100)
    octets = F.transform(F.split(normal, r"\."), lambda o, i: octet(o, i).cast("string"))
    head = F.concat(F.substring(normal, 1, 1), _mapped(seed, F.expr("substring(normal, 2, length(normal) - 2)"), _ALPHABETS[:1]))
    last = F.substring(normal, -1, 1)
    body = F.expr("substring(normal, 1, length(normal) - 1)")
    card = F.concat(head, F.when(_luhn(body) == last, _luhn(head)).otherwise(_draw(seed, F.lit(99), 10).cast("string")))
    area = F.concat((_draw(seed, F.lit(-1), 8) + 2).cast("string"), _mapped(seed, F.substring(normal, 2, 2), _ALPHABETS[:1]))
    longer = lambda c: F.concat(c, F.repeat(F.regexp_extract(c, r"([\p{L}0-9])[^\p{L}0-9]*$", 1), max(0, attempt - 1)))
    top = F.substring_index(normal, ".", -1)
    rest = F.expr("substring(normal, 1, length(normal) - length(substring_index(normal, '.', -1)) - 1)")
    hexed = F.array_join(F.transform(_chars(normal), lambda x, i: F.lit("0123456789abcdef").substr(_draw(seed, i, 16) + 1, F.lit(1))), "")
    return (
        F.when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", card).when(kind == "phone", F.concat(area, _mapped(F.concat(seed, F.lit("n")), F.substring(normal, 4, 7), _ALPHABETS[:1])))
        .when(kind == "email", _mapped(seed, longer(F.substring_index(normal, "@", 1)))).when(kind == "domain", F.concat(_mapped(seed, longer(rest)), F.lit("."), top)).when(kind == "hex", hexed).when(kind == "ssn", _mapped(seed, normal))
        .when(kind == "iban", _iban(seed, normal)).when(kind == "cloud", F.concat(F.substring(normal, 1, 4), _mapped(seed, F.expr("substring(normal, 5, length(normal))")))).otherwise(_mapped(seed, longer(normal)))
    )


def surrogates(entities: DataFrame, key: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """entities: kind, normal, distinct. Adds surrogate: distinct within a kind, none of them an entity of that kind.

    The surrogate of a mail address is that of its local part, distinct within the domain; ``domain`` is a kind of its own."""
    key = key or configured_key(entities.sparkSession)
    mail = F.col("kind") == "email"
    scope = F.when(mail, F.substring_index("normal", "@", -1)).otherwise("").alias("scope")

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        seed = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "normal", F.lit(str(attempt))), 256)
        return rows.withColumn("seed", seed).withColumn("surrogate", _surrogate(F.col("kind"), F.col("normal"), F.col("seed"), attempt)).select("kind", "normal", scope, "surrogate")

    by = ["kind", "scope", "surrogate"]
    taken = entities.select("kind", scope, F.when(mail, F.substring_index("normal", "@", 1)).otherwise(F.col("normal")).alias("surrogate"))
    done, open_ = None, entities.select("kind", "normal")
    for attempt in range(rounds):
        now = drawn(open_, attempt).withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("normal")))
        used = taken if done is None else taken.union(done.select(*by))
        clash = now.join(used.withColumn("used", F.lit(True)).distinct(), by, "left")
        now = checkpointed(clash.withColumn("good", F.col("used").isNull() & (F.col("turn") == 1)).select(*by, "normal", "good"))
        good = now.where("good").select(*by, "normal")
        done = good if done is None else done.union(good)
        open_ = now.where("not good").select("kind", "normal")
        if open_.isEmpty():
            return done.select("kind", "normal", "surrogate")
    raise RuntimeError(f"{open_.count()} entities have no surrogate of their own after {rounds} draws: a kind has almost as many entities as forms")


def _given(key: str) -> Column:
    """Each known given name to another of its gender and script: a keyed cycle over the list."""
    import hashlib

    pairs: dict[str, str] = {}
    for names in GIVEN.values():
        turned = sorted(names, key=lambda n: hashlib.sha256(f"{key}{n}".encode()).digest())
        pairs |= dict(zip(turned, turned[1:] + turned[:1]))
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _cased(s: Column, like: Column) -> Column:
    """s with capitals where ``like`` has them; what is beyond it stays small."""
    return F.array_join(F.zip_with(_chars(s), F.slice(_chars(like), F.lit(1), F.length(s)), lambda a, b: F.when((b == F.upper(b)) & (b != F.lower(b)), F.upper(a)).otherwise(a)), "")


def _laid(e: Column, surrogate: Column) -> Column:
    """The surrogate's characters at the places of e's digits (the last ones; others stay), or letters and digits."""
    after = lambda i: F.length(_digits(F.substr(e, i + 1)))
    n = F.length(surrogate)
    return F.array_join(F.transform(_chars(e), lambda c, i: F.when(c.rlike("[0-9]") & (after(i) <= n), F.substr(surrogate, n - after(i) + 1, F.lit(1))).otherwise(c)), "")


def _placed(kind: Column, e: Column, surrogate: Column, inner: Column, inner_new: Column, key: str) -> Column:
    """The entity's replacement where it is written as ``e``; inner: its domain or unlisted given name, and inner_new that one's surrogate."""
    words = F.split(e, " ")
    given = _given(key)
    head = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.coalesce(F.try_element_at(given, w), F.when(F.lower(w) == inner, _cased(inner_new, w)), w))
    last = F.element_at(words, -1)
    person = F.array_join(F.concat(head, F.array(_cased(surrogate, last))), " ")
    after = lambda i: F.length(F.regexp_replace(F.substr(e, F.lit(1), i), " ", ""))
    spaced = F.array_join(F.transform(_chars(e), lambda c, i: F.when(c == " ", c).otherwise(F.substr(surrogate, after(i) + 1, F.lit(1)))), "")
    mail = F.concat(_cased(surrogate, F.substring_index(e, "@", 1)), F.lit("@"), _cased(inner_new, F.substring_index(e, "@", -1)))
    return F.when(kind == "person", person).when(kind.isin("phone", "card", "ssn"), _laid(e, surrogate)).when(kind == "iban", spaced).when(kind == "email", mail).otherwise(surrogate)


def has_entity(text: Column) -> Column:
    mark = text.rlike(MARK)
    lower = F.lower(text)
    for word in MARK_WORDS:
        mark = mark | lower.contains(word)
    return F.coalesce((mark | text.rlike(MARK_NAME)) & text.rlike(ENTITY), F.lit(False))


def replace(df: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """df with every entity of the text column replaced; count names an added column with the number of entities."""
    key = key or configured_key(df.sparkSession)
    mark, held_list, news = fresh(df, "text_key", "entities", "news")
    body = F.col(f"`{text}`")
    held = checkpointed(df.where(has_entity(body)).withColumn(mark, F.sha2(body, 256)).withColumn(held_list, F.regexp_extract_all(body, F.lit(ENTITY), F.lit(0))))
    bare = df.where(~has_entity(body))
    #: Each distinct text's entities once; texts stay where they are.
    once = held.groupBy(F.col(mark).alias("text_key")).agg(F.first(held_list).alias("entities")).select("text_key", F.posexplode("entities").alias("place", "entity"))
    noted = once.withColumn("kind", _kind(F.col("entity"))).withColumn("normal", _normal(F.col("kind"), F.col("entity")))
    first = F.element_at(F.split(F.regexp_replace("entity", rf"^(?:{_TITLE})\.? ", ""), " "), 1)
    listed = F.array(*[F.lit(n) for names in GIVEN.values() for n in names])
    unlisted = (F.col("kind") == "person") & (F.lower(first) != F.col("normal")) & ~F.array_contains(listed, first)
    found = checkpointed(noted.withColumn("inner_kind", F.when(F.col("kind") == "email", "domain").when(unlisted, "given")).withColumn("inner", F.when(F.col("kind") == "email", F.substring_index("normal", "@", -1)).when(unlisted, F.lower(first))))
    entities = found.select("kind", "normal").union(found.where("inner is not null").select("inner_kind", "inner")).distinct()
    mapping = surrogates(entities, key)
    inner = mapping.select(F.col("kind").alias("inner_kind"), F.col("normal").alias("inner"), F.col("surrogate").alias("inner_new"))
    placed = found.join(mapping, ["kind", "normal"]).join(inner, ["inner_kind", "inner"], "left").select("text_key", "place", _placed(F.col("kind"), F.col("entity"), F.col("surrogate"), F.col("inner"), F.col("inner_new"), key).alias("new"))
    lists = placed.groupBy(F.col("text_key").alias(mark)).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]).alias(news))
    between = F.split(body, ENTITY, -1)
    new_text = F.array_join(F.flatten(F.zip_with(between, F.concat(F.col(news), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    columns = lambda value, n: [value.alias(x) if x == text else F.col(f"`{x}`") for x in df.columns] + ([n.alias(count)] if count else [])
    changed = held.join(lists, mark).select(*columns(new_text, F.size(news).cast("long")))
    return changed.union(bare.select(*columns(body, F.lit(0).cast("long"))))
