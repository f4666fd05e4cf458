"""PII surrogates in DataFrame functions only.

One pattern finds addresses, numbers, secrets and titled names.  A text becomes pieces: a
lead of plain text and the entity behind it.  Every distinct entity of the corpus gets a
replacement drawn by a keyed hash, character by character within its class and script, so
format, case and type stay; card numbers keep a valid check digit, names are built from
syllables of their script with an ending of their gender.  Replacements are checked:
where two entities of a kind would share one, or one equals a real entity or itself, all
but the first draw again.  A later draw of a name or a short number is longer, so there
are always enough of them.

The same entity has the same replacement everywhere, whatever its spelling of case,
separators or country code.  A name found behind its title is also replaced where a part
of it stands alone in the same text.  A given name takes the gender of its titles, a
surname is shared by all who bear it.

Names without a title anywhere in their text, initials, and name parts beyond the fourth
are not found; addresses and secrets may have any length.  Only rows
that hold an entity are shuffled.

Cases: null texts stay null; null ids are kept; repeated rows are each returned; texts
without entities come back unchanged; extra columns are kept whatever their names, but a
column ``n_entities`` is replaced; in a text of any length each mention is looked up by
its place; of kinds that fit alike the first listed counts; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
HEX = "[0-9A-Fa-f]{1,4}"
# Titles by gender of the person named, and honorifics that follow a name.
MALE = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don", "Господин", "Г-н", "Κύριος", "السيد", "מר", "श्री"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña", "Госпожа", "Г-жа", "Κυρία", "السيدة", "גברת", "श्रीमती"]
NEUTRAL = ["Dr", "Doctor", "Docteur", "Doktor", "Prof", "Professor", "Доктор", "Профессор", "الدكتور", "डॉ"]
HONORIFICS = ["先生", "女士", "小姐", "教授", "医生", "博士", "さん", "様", "氏", " ?씨", " ?님"]
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林郑谢罗梁宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
# Scripts as ranges and a look at the first character: a pattern is tried at every place of a text.
HAN, HANGUL, UNCASED_LETTER = "\u3400-\u4dbf\u4e00-\u9fff", "\uac00-\ud7a3", "\u0590-\u06ff\u0900-\u097f"
FIRST = "(?=[" + "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL})) + "])"
TITLE = FIRST + r"(?<![\p{L}\p{N}])(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? "
INITIALS = r"(?:\p{Lu}\. ?){0,3}"
CASED = r"\p{Lu}[\p{L}'’-]++(?: \p{Lu}[\p{L}'’-]++){0,3}"
UNCASED = f"[{UNCASED_LETTER}]{{2,30}}+(?: [{UNCASED_LETTER}]{{2,30}}+)?"
FOLLOWED = "(?=" + "|".join(HONORIFICS) + ")"
EASTERN = f"[{SURNAMES}][{HAN}]{{0,2}}{FOLLOWED}|(?<![{HAN}])[{HAN}]{{1,4}}{FOLLOWED}|(?<![{HANGUL}])[{HANGUL}]{{2,4}}(?= ?(?:씨|님)(?:[가는을를의도와에께이은]|(?![{HANGUL}])))"
# What each kind of entity looks like, the first that fits counts.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,6}\.\p{L}{2,24}",
    "secret": r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|[0-9a-fA-F]{32,}+)(?![A-Za-z0-9_])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}(?:[ -]?\d{4}){3}(?:[ -]?\d{1,3})?|3[47]\d{2}[ -]?\d{6}[ -]?\d{5}|3[068]\d{2}[ -]?\d{6}[ -]?\d{4}|4\d{12})(?!\d)",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{2,6}}(?::{HEX}){{1,5}}|{HEX}::(?:{HEX}:){{1,5}}{HEX})(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[-.])\d{3,4}[ .-]?\d{4}(?!\d)|(?<![\d+])(?:\+\d{1,3} )?\d{3} \d{3} \d{4}(?! ?\d)|(?<!\d)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "name": rf"{TITLE}(?:{INITIALS}{CASED}|{UNCASED})|{EASTERN}",
}
_NUMERIC = ("ssn", "card", "ip", "phone")
PATTERN = "|".join([*(KINDS[k] for k in ("email", "secret", "iban")), "(?=[0-9+(])(?:" + "|".join(KINDS[k] for k in _NUMERIC) + ")", KINDS["ip6"], KINDS["name"]])
# What every entity holds: a digit, an @, a title or honorific, or the start or length of a secret.
HINT = "[0-9@]|" + FIRST + r"(?<!\p{L})(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")[. ]|AKIA|gh[pousr]_|sk-|[a-fA-F]{32}|::|" + "|".join(HONORIFICS)
# Scripts with the syllables that names are built from, endings by gender
# (female, male, any), and the letters of other entities.
SCRIPTS = {
    "IsCyrillic": ("ба ве да до га жи ка ла ле ли ло ма ми мо на не но па ра ре ро са се та те ва ви зо ру ту", ("на", "н", "р"), "абвгдежзиклмнопрстуфхцчшщэюя"),
    "IsGreek": ("βα δα δη φα γα κα λα λε λη λο μα με μη μο να νε νο πα ρα ρε ρο σα σε τα τε βη ζω θα θε ξα", ("να", "ς", "ρ"), "αβγδεζηθικλμνξοπρστυφχψω"),
    "IsArabic": ("با تا جا دا را سا فا كا لا ما نا وا بي تي جي دي ري سي في كي لي مي ني", ("ة", "ن", "ر"), "ابتجحدرزسشصطعفقكلمنهوي"),
    "IsHebrew": ("בא גא דא הא לא מא נא רא שא תא בי גי די לי מי ני רי שי תי קו לו מו נו", ("ה", "ן", "ר"), "אבגדהוזחטיכלמנסעפצקרשת"),
    "IsDevanagari": ("का की ना नी मा मी रा री सा सी ता ती ला ली वा वी दा दी पा पी", ("ी", "न", "र"), "कखगघचजटडतदनपबमयरलवसह"),
    "IsHangul": ("가 나 다 라 마 바 사 아 자 하 민 수 진 영 희 준 지 현 호 은 서 도 윤 우 재", ("", "", ""), "가나다라마바사아자차카타파하"),
    "IsHan": ("文 明 华 国 平 海 林 山 春 秋 雨 云 天 星 月 江 河 清 安 宁 和 光 永 福 德 仁 义 思 远 志 成 立 新 建 庆 元", ("", "", ""), "文明华国平海林山春秋雨云天星月江河清安宁和光永福德仁义思远志成"),
}
LATIN = ("ba be da do fa fe ga ka ke la le li lo ma me mi mo na ne no pa ra re ro sa se ta te va vi", ("na", "n", "r"), "àáâäèéêëìíîïòóôöùúûü")
UNSPACED = r"^[\p{IsHan}\p{IsHangul}]"
DIGITS = ("phone", "card", "ssn")


def kind_of(match: Column) -> Column:
    """The first kind whose whole pattern the match fits."""
    out = F.lit("name")
    for kind, pattern in reversed([*KINDS.items()][:-1]):
        out = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, token: Column) -> Column:
    """What spellings of one entity share; a phone number's last ten digits."""
    digits = F.regexp_replace(token, r"[^0-9]", "")
    plain = F.when(kind == "iban", F.replace(token, F.lit(" "), F.lit(""))).when(kind == "secret", token).otherwise(F.lower(token))
    return F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "ssn"), digits).otherwise(plain)


def pieces(lead: Column, match: Column) -> Column:
    """The entities of a match as structs of lead, token, kind, entity and gender flags."""
    kind = kind_of(match)
    prefix = F.regexp_extract(match, f"^({TITLE}{INITIALS})(?=[\\p{{L}}])", 1)
    title = F.regexp_extract(match, r"^([\p{L}\p{M}-]+)", 1)
    bare = F.when(kind == "name", F.substr(match, F.length(prefix) + 1)).otherwise(match)
    tokens = F.when(kind == "name", F.split(bare, " ")).otherwise(F.array(match))

    def piece(t: Column, i: Column) -> Column:
        given = (kind == "name") & (i < F.size(tokens) - 1)
        before = F.when(i > 0, F.lit(" ")).when(kind == "name", F.concat(lead, prefix)).otherwise(lead)
        return F.struct(
            before.alias("lead"), t.alias("token"), kind.alias("kind"), canonical(kind, t).alias("entity"), (given & title.isin(FEMALE)).alias("female"),
            (given & title.isin(MALE)).alias("male"), ((kind == "name") & ((i == 0) | t.rlike(r"^\p{Lu}"))).alias("alone"),
        )

    return F.transform(tokens, piece)


def _draw(stream: Column, k: Column, n: int) -> Column:
    """A number below ``n`` from the k-th byte pair of a hash stream."""
    return F.conv(F.substring(stream, (k * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long") % n


def surrogate(kind: Column, entity: Column, gender: Column, key: str, attempt: Column) -> Column:
    """The replacement of a canonical entity drawn in one attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string"))
    stream = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("+")), 512))
    # two hashes serve 64 characters; a longer entity has one more for every 32
    drawn = F.length(entity) + attempt + 8
    further = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), (drawn / 32).cast("int"))), lambda b: F.sha2(F.concat(seed, F.lit("+"), b.cast("string")), 512))
    stream = F.when(drawn > 64, F.concat(stream, F.array_join(further, ""))).otherwise(stream)
    longer = F.when(kind.isin("phone", "ssn"), F.repeat(F.lit("0"), F.greatest(attempt - 3, F.lit(0)))).otherwise("")
    form = F.concat(entity, longer)
    chars = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.struct(F.substring(form, i, F.lit(1)).alias("c"), (i - 1).alias("k")))

    def pick(pool: str, k: Column) -> Column:
        return F.substring(F.lit(pool), (_draw(stream, k, len(pool)) + 1).cast("int"), F.lit(1))

    def mapped(hexadecimal: bool) -> Column:
        letters = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"

        def swap(x: Column) -> Column:
            out = F.when(x["c"].rlike("[0-9]"), pick("0123456789", x["k"])).when(x["c"].rlike("[a-z]"), pick(letters, x["k"])).when(x["c"].rlike("[A-Z]"), pick(letters.upper(), x["k"]))
            for script, (_, _, pool) in SCRIPTS.items():
                out = out.when(x["c"].rlike(rf"\p{{{script}}}"), pick(pool, x["k"]))
            return out.when(x["c"].rlike(r"\p{L}"), pick(LATIN[2], x["k"])).otherwise(x["c"])

        return F.array_join(F.transform(chars, swap), "")

    local = F.substring_index(mapped(False), "@", 1)
    email = F.concat(local, F.lit("@"), F.substring(F.sha2(F.concat(seed, F.lit("@")), 256), 1, 8), F.lit(".example"))
    octets = F.concat_ws(".", *((_draw(stream, F.lit(k), 254) + 1).cast("string") for k in range(4)))
    body = F.substring(mapped(False), F.lit(1), F.length(entity) - 1)
    doubled = F.transform(F.sequence(F.lit(1), F.length(body)), lambda i: F.substring(body, i, F.lit(1)).cast("int") * F.when((F.length(body) - i) % 2 == 0, 2).otherwise(1))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    card = F.concat(body, ((10 - luhn % 10) % 10).cast("string"))
    mark = F.regexp_extract(entity, r"^(AKIA|gh[pousr]_|sk-)?", 0)
    tail = F.substring(F.when(entity.rlike("^[0-9a-fA-F]+$"), mapped(True)).otherwise(mapped(False)), F.length(mark) + 1, F.length(entity))
    iban = F.concat(F.substring(entity, 1, 2), F.substring(mapped(False), F.lit(3), F.length(entity)))

    def spelled(syllables: str, endings: tuple[str, str, str]) -> Column:
        pool = syllables.split()
        count = F.length(entity) if not endings[0] else F.least(F.lit(8), F.greatest(F.lit(3), (F.length(entity) / 2).cast("int") + 1))
        drawn = F.transform(F.sequence(F.lit(1), count + attempt), lambda k: F.element_at(F.array(*map(F.lit, pool)), (_draw(stream, k, len(pool)) + 1).cast("int")))
        return F.concat(F.array_join(drawn, ""), F.when(gender == "f", endings[0]).when(gender == "m", endings[1]).otherwise(endings[2]))

    name = reduce(lambda out, s: F.when(entity.rlike(rf"\p{{{s}}}"), spelled(*SCRIPTS[s][:2])).otherwise(out), SCRIPTS, spelled(*LATIN[:2]))
    return (
        F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "ip6", mapped(True)).when(kind == "card", card).when(kind == "secret", F.concat(mark, tail))
        .when(kind == "iban", iban).when(kind == "name", name).otherwise(mapped(False))
    )


def surrogates(ws: Workspace, entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, surrogate`` of ``kind, entity, female, male``: distinct within a kind, and no real entity of it."""
    partitions = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    only = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").when(F.col("entity").rlike("(?:[оеё]ва|ина|ая)$"), "f").otherwise("n")
    drawn = lambda attempt: surrogate(F.col("kind"), F.col("entity"), F.col("gender"), key, attempt)
    table = entities.groupBy("kind", "entity").agg(F.bool_or("female").alias("f"), F.bool_or("male").alias("m")).select("kind", "entity", only.alias("gender"), F.lit(0).alias("attempt"))
    # Drawing is work for the processor on few bytes, so it is dealt out; by another key than the group-by, or that exchange would serve and be merged.
    table = ws.save(table.repartition(partitions, "entity").withColumn("surrogate", drawn(F.lit(0))))
    while True:
        shared = table.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "entity")).alias("first"))
        real = table.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        judged = table.join(shared, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = F.col("real").isNotNull() | ((F.col("n") > 1) & (F.struct("attempt", "entity") != F.col("first")))
        judged = ws.save(judged.select("kind", "entity", "gender", "attempt", "surrogate", clash.alias("clash")))
        if judged.where("clash").isEmpty():
            return judged.select("kind", "entity", "surrogate")
        again = F.col("attempt") + F.col("clash").cast("int")
        redrawn = judged.repartition(partitions, "entity").select("kind", "entity", "gender", again.alias("attempt"), F.when(F.col("clash"), drawn(again)).otherwise(F.col("surrogate")).alias("surrogate"))
        ws.drop(table)
        table = ws.save(redrawn)
        ws.drop(judged)


def shaped(kind: Column, token: Column, new: Column) -> Column:
    """A replacement in the separators, country code and case of the token that it stands for."""
    total = F.length(F.regexp_replace(token, r"[^0-9]", ""))
    kept = F.when(kind == "phone", F.greatest(total - 10, F.lit(0))).otherwise(0)
    chars = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.substring(token, i, F.lit(1)))

    def step(a: Column, ch: Column) -> Column:
        here = ch.rlike("[0-9]") | ((kind == "iban") & ch.rlike("[A-Za-z]"))
        return F.struct(F.concat(a["s"], F.when(here & (a["k"] >= kept), F.substring(new, a["k"] - kept + 1, F.lit(1))).otherwise(ch)).alias("s"), (a["k"] + F.when(here, 1).otherwise(0)).alias("k"))

    done = F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), step)
    filled = F.concat(done["s"], F.substring(new, done["k"] - kept + 1, F.length(new)))
    cased = F.when(token == F.upper(token), F.upper(new)).when(F.substring(token, 1, 1) != F.lower(F.substring(token, 1, 1)), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
    return F.when(kind.isin(*DIGITS, "iban"), filled).when(kind == "secret", new).otherwise(cased)


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text column and the column ``n_entities``."""
    ws = Workspace(docs.sparkSession, "pii")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns if c != "n_entities")).alias("row"))
    text = F.col("row").getField(text_col)
    met = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    # One pass over the texts: rows without an entity are written beside the others.
    cut = rows.withColumn("m", met).withColumn("between", F.when(F.size("m") > 0, F.split(text, PATTERN, -1)))
    inner = F.slice("between", 1, F.size("m"))
    some = lambda c: F.when(F.col("between").isNotNull(), c)
    cut = ws.save(cut.select(
        "row", some(F.xxhash64(text)).alias("a"), some(F.crc32(text.cast("binary"))).alias("b"), some(F.flatten(F.zip_with(inner, "m", pieces))).alias("p"), some(F.element_at("between", -1)).alias("tail"),
        some(F.size("m").cast("long")).alias("n"),
    ))
    plain = cut.where("p is null").select("row.*", F.lit(0).cast("long").alias("n_entities"))
    found = cut.where("p is not null")
    mention = found.select("a", "b", F.posexplode("p").alias("at", "e")).select("a", "b", "at", "e.kind", "e.entity", "e.female", "e.male", "e.alone")
    mention = ws.save(mention.dropDuplicates(["a", "b", "at"]))  # equal texts once
    table = surrogates(ws, mention.select("kind", "entity", "female", "male"), key)
    told = mention.join(table, ["kind", "entity"])
    mine = told.groupBy("a", "b").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "surrogate"))), lambda s: s["surrogate"]).alias("new"),
        F.map_from_entries(F.collect_set(F.when(F.col("alone"), F.struct("entity", "surrogate")))).alias("known"),
    )
    joined = found.join(mine, ["a", "b"])

    # Parts of a titled name that stand alone, in the leads and in the tail of the same text.
    tokens = F.array_distinct(F.flatten(F.transform(F.filter("p", lambda x: x["alone"]), lambda x: F.array(x["token"], F.upper(x["token"])))))
    tokens = F.filter(tokens, lambda t: F.length(t) > 1)
    alternative = F.transform(tokens, lambda t: F.when(t.rlike(UNSPACED), t).otherwise(F.concat(F.lit(r"(?<![\p{L}\p{N}])"), t, F.lit(r"(?![\p{L}\p{N}@])"))))
    joined = joined.withColumn("bare", F.when(F.size(tokens) > 0, F.array_join(alternative, "|")))

    def cleared(lead: Column) -> Column:
        met = F.regexp_extract_all(lead, F.col("bare"), F.lit(0))
        fresh = F.transform(met, lambda t: F.coalesce(shaped(F.lit("name"), t, F.col("known")[F.lower(t)]), t))
        parted = F.zip_with(F.split(lead, F.col("bare"), -1), F.concat(fresh, F.array(F.lit(""))), lambda x, y: F.concat(x, y))
        return F.when(F.col("bare").isNotNull() & F.rlike(lead, F.col("bare")), F.array_join(parted, "")).otherwise(lead)

    own = F.zip_with("p", "new", lambda x, new: F.concat(cleared(x["lead"]), shaped(x["kind"], x["token"], new)))
    whole = F.concat(F.array_join(own, ""), cleared(F.col("tail")))
    leads = F.concat(F.transform("p", lambda x: x["lead"]), F.array("tail"))
    more = F.when(F.col("bare").isNotNull(), F.aggregate(leads, F.lit(0), lambda s, lead: s + F.regexp_count(lead, F.col("bare")))).otherwise(0)
    changed = joined.select(F.col("row").withField(f"`{text_col}`", whole).alias("row"), (F.col("n") + more).alias("n_entities"))
    return plain.unionByName(changed.select("row.*", "n_entities"))
