"""Text functions of reply scoring and normalisation, as Catalyst expressions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alphabets, reply patterns and limits that decide how a reply is scored.
LETTERS, LETTERS_WIDE = "A-Ja-j", "A-Pa-p"
STATED = r"(?i)(?:answer|option|choice)\s*(?:is|would\s+be)?\s*[:\-]?\s*[(\[]?([%s])[)\].,:]?(?=\s|$)"
STATED_ZH = r"答案\s*(?:是|为)?\s*[:：]?\s*[(\[]?([A-Ja-j])(?![A-Za-z])"
NUMBER_STATED = r"(?i)\b(?:is|are|answer|answered|total|count)\b[^0-9\n]{0,20}?(\d+(?:\.\d+)?)"
NUMBER_ALONE = r"(?U)(?<![\w.])(\d+(?:\.\d+)?)(?!\w)"
SOUND = r"(?i)\b(hear|heard|hears|sound|sounds|audio|listen|voice|voices|spoken|speech|says?|said|music|song|noise|narrat\w+|dialogue|conversation)\b"
LONG_TEXT_WORDS = 10
IOU_MIN = 0.5
SAME_NUMBER = 1e-6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_marks(c: Column | str) -> Column:
    """Full-width punctuation to ASCII; asterisks and hashes removed."""
    return F.regexp_replace(F.translate(_col(c), "（）：。，", "():.,"), r"[*#]", "")


def norm_text(c: Column | str) -> Column:
    """Lower case, one kind of apostrophe, only word characters, dots, dashes and single blanks, no dots at either end."""
    s = F.lower(F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", ""))
    s = F.regexp_replace(s, "[‘’“”`]", "'")
    s = F.regexp_replace(s, r"(?U)[^\w\s.\-]", " ")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(s, r"^\.+|\.+$", ""))


def strip_letter(c: Column) -> Column:
    """An option's text without its own leading letter."""
    return F.trim(F.regexp_replace(c, r"^\s*[(\[]?[A-Ja-j][)\].,:]\s+", ""))


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[.\-]", " "), r"\s+", " "))


def _said_letter(s: Column, wide: Column | None = None) -> Column:
    """Leading letter, else the last stated one, else the last one stated in Chinese; ``s`` has plain marks and no outer blanks."""

    def leading(alphabet: str) -> Column:
        pattern = rf"^\s*[(\[]?([{alphabet}])[)\].,:]?(?:\s|$)"
        letter = F.upper(F.regexp_extract(s, pattern, 1))
        marked = F.regexp_extract(s, pattern, 0).rlike(r"[()\[\].,:]")
        return F.when((letter != "") & (marked | ~letter.isin("A", "I") | ~s.rlike(r"\S\s+\S")), letter)

    last = lambda pattern: F.upper(F.try_element_at(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), F.lit(-1)))
    narrow = F.coalesce(leading(LETTERS), last(STATED % LETTERS))
    said = narrow if wide is None else F.when(wide, F.coalesce(leading(LETTERS_WIDE), last(STATED % LETTERS_WIDE))).otherwise(narrow)
    return F.coalesce(said, last(STATED_ZH))


def stated_letter(c: Column | str) -> Column:
    """The last letter that a text states as its answer, option or choice; null without one."""
    found = F.regexp_extract_all(_col(c), F.lit(STATED % LETTERS), F.lit(1))
    return F.upper(F.try_element_at(found, F.lit(-1)))


def mentions_sound(c: Column | str) -> Column:
    """Whether a text speaks of sound; false for null."""
    return F.coalesce(_col(c).rlike(SOUND), F.lit(False))


def _option_place(s: Column, norm: Column, texts: Column) -> Column:
    """Place of the option whose text the reply is, else of the only one it contains, else its bare index; ``texts`` holds
    struct(i, whole, bare, flat) per option."""
    exact = F.filter(texts, lambda x: (norm != "") & ((x["whole"] == norm) | (x["bare"] == norm)))
    padded = F.concat(F.lit(" "), _flat(norm), F.lit(" "))
    inside = F.filter(texts, lambda x: (F.length(x["flat"]) >= 3) & F.contains(padded, F.concat(F.lit(" "), x["flat"], F.lit(" "))))
    number = F.when(s.rlike(r"^\d{1,2}$"), s.try_cast("int"))
    by_text = F.coalesce(F.try_element_at(exact, F.lit(1))["i"], F.when(F.size(inside) == 1, F.try_element_at(inside, F.lit(1))["i"]))
    return F.coalesce(by_text, F.when(number < F.size(texts), number))


def _option_texts(opts: Column) -> Column:
    """struct(i, whole, bare, flat) per option: normalised with and without its letter, and with dots and dashes as blanks."""
    pairs = F.transform(opts, lambda o, i: F.struct(i.alias("i"), norm_text(o).alias("whole"), norm_text(strip_letter(o)).alias("bare")))
    return F.transform(pairs, lambda x: F.struct(x["i"].alias("i"), x["whole"].alias("whole"), x["bare"].alias("bare"), _flat(x["bare"]).alias("flat")))


def reply_letter(reply: Column | str, options: Column | str | None = None) -> Column:
    """Option letter of a reply: leading letter, last stated answer, exact option text, the only contained option text, bare
    index; null if none applies. A bare leading A or I counts only when the reply is that one word. More than ten options
    widen the alphabet. ``options`` is array<string> or null. For large tables ``with_letter`` gives the same, in steps."""
    s = F.trim(plain_marks(reply))
    if options is None:
        return F.when(_col(reply).isNotNull(), _said_letter(s))
    opts = _col(options)
    place = _option_place(s, norm_text(s), _option_texts(opts))
    return F.when(_col(reply).isNotNull(), F.coalesce(_said_letter(s, F.coalesce(F.size(opts) > 10, F.lit(False))), letter_of(place)))


def with_letter(df: DataFrame, out: str, reply: Column | str, options: Column | str | None = None) -> DataFrame:
    """``df`` with the reply's letter as ``out``. Each part is computed once per row, in a projection of its own."""
    step = df.withColumn("__s", F.trim(plain_marks(reply)))
    if options is None:
        return step.withColumn(out, _said_letter(F.col("__s"))).drop("__s")
    step = step.withColumns({"__n": norm_text("__s"), "__t": _option_texts(_col(options)), "__w": F.coalesce(F.size(_col(options)) > 10, F.lit(False))})
    place = letter_of(_option_place(F.col("__s"), F.col("__n"), F.col("__t")))
    return step.withColumn(out, F.coalesce(_said_letter(F.col("__s"), F.col("__w")), place)).drop("__s", "__n", "__t", "__w")


def letter_of(index: Column) -> Column:
    """0 -> A; null outside A to Z."""
    return F.when((index >= 0) & (index < 26), F.char(index.cast("int") + 65))


def index_of(letter: Column) -> Column:
    return F.ascii(letter) - 65


def letter_set(reply: Column | str, wide: Column | None = None) -> Column:
    """Sorted letters of a multi-select reply: the comma form, else upper-case letters standing alone except I; null if none."""
    s = plain_marks(reply)

    def one(alphabet: str) -> Column:
        listed = F.regexp_extract_all(F.upper(s), F.lit(f"[{alphabet[:3]}]"), F.lit(0))
        alone = F.filter(F.regexp_extract_all(s, F.lit(rf"(?U)\b([{alphabet[:3]}])\b"), F.lit(1)), lambda x: x != "I")
        out = F.when(s.rlike(rf"^\s*[{alphabet}](\s*,\s*[{alphabet}])+\s*$"), listed).otherwise(alone)
        return F.when(F.size(out) > 0, F.array_sort(F.array_distinct(out)))

    return one(LETTERS) if wide is None else F.when(wide, one(LETTERS_WIDE)).otherwise(one(LETTERS))


def numbers(c: Column | str) -> Column:
    """The numbers of a text that holds nothing else, else null (plain and exponent notation; not nan or inf)."""
    parts = F.filter(F.split(F.regexp_replace(_col(c), r"[\[\](){},;:]", " "), r"\s+"), lambda x: x != "")
    values = F.transform(parts, lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double")))
    return F.when((F.size(parts) > 0) & F.forall(values, lambda v: v.isNotNull()), values)


def first_interval(c: Column | str) -> Column:
    """First two unsigned numbers of a text as array<double>, else null."""
    found = F.transform(F.regexp_extract_all(_col(c), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    return F.when(F.size(found) >= 2, F.slice(found, 1, 2))


def stated_number(c: Column | str) -> Column:
    """Last number after is/are/answer/total/count, else the last number standing alone, else null."""
    s = F.regexp_replace(_col(c), ",", "")
    last = lambda p: F.try_element_at(F.regexp_extract_all(s, F.lit(p), F.lit(1)), F.lit(-1)).cast("double")
    return F.coalesce(last(NUMBER_STATED), last(NUMBER_ALONE))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union of two intervals in any order of ends; two points: 1 if equal, else 0."""
    lo_a, hi_a, lo_b, hi_b = F.least(a0, a1), F.greatest(a0, a1), F.least(b0, b1), F.greatest(b0, b1)
    inter = F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))
    union = F.greatest(hi_a, hi_b) - F.least(lo_a, lo_b)
    return F.when(union > 0, inter / union).otherwise(F.when(F.abs(lo_a - lo_b) <= SAME_NUMBER, 1.0).otherwise(0.0))


def with_score(df: DataFrame, out: str, reply: Column | str, gold: Column | str, options: Column | str | None = None, form: Column | str | None = None) -> DataFrame:
    """``df`` with the rule score of the reply as ``out``: true, false, or null where no rule can judge a free-text gold.

    Null reply or gold is false. In order: multi-select gold (set equality); multiple choice with options (letters, else
    texts); multiple choice without options (letters); interval gold (overlap at least half); number lists; one number
    stated in prose; long gold (null); normalised equality. Parts are computed once per row, in projections of their own.
    """
    opts = _col(options) if options is not None else F.lit(None).cast("array<string>")
    choice = F.coalesce(F.size(opts) >= 2, F.lit(False))
    if form is not None:
        choice = choice | F.coalesce(F.upper(F.trim(_col(form))) == "MCQ", F.lit(False))
    parts = {"__r": _col(reply), "__g": _col(gold), "__o": opts, "__choice": choice}
    step = df.withColumns(parts).withColumns({"__sr": F.trim(plain_marks("__r")), "__sg": F.trim(plain_marks("__g")), "__w": F.coalesce(F.size("__o") > 10, F.lit(False))})
    step = step.withColumns({"__dr": _said_letter(F.col("__sr"), F.col("__w")), "__dg": _said_letter(F.col("__sg"), F.col("__w"))})
    vague = F.col("__dr").isNull() | F.col("__dg").isNull()  # only then do the options' texts matter
    step = step.withColumn("__t", F.when(vague, _option_texts(F.col("__o"))))
    place = lambda said, s, n: F.coalesce(F.col(said), F.when(vague, letter_of(_option_place(F.col(s), n, F.col("__t")))))
    step = step.withColumns({"__rl": place("__dr", "__sr", norm_text("__sr")), "__gl": place("__dg", "__sg", norm_text("__sg"))})
    narrow = lambda said, s: F.when(F.col("__w"), _said_letter(F.col(s))).otherwise(F.col(said))
    by_rule = ~(F.col("__choice") & F.coalesce(F.size("__o") > 0, F.lit(False)))  # no options to compare with
    step = step.withColumns({"__tr": F.when(by_rule | vague, norm_text("__r")), "__tg": F.when(by_rule | vague, norm_text("__g"))})
    at = lambda letter, raw: norm_text(F.coalesce(strip_letter(F.try_element_at(F.col("__o"), index_of(F.col(letter)) + 1)), F.col(raw)))
    open_ = F.col("__rl").isNull() | F.col("__gl").isNull()
    step = step.withColumns({"__br": narrow("__dr", "__sr"), "__bg": narrow("__dg", "__sg"), "__nr": F.when(by_rule, numbers("__r")), "__ng": F.when(by_rule, numbers("__g")), "__said": F.when(by_rule, stated_number("__r")), "__first": F.when(by_rule, first_interval("__r")), "__or": F.when(open_, at("__rl", "__r")), "__og": F.when(open_, at("__gl", "__g")), "__plain": plain_marks("__g")})
    c = {n: F.col(f"__{n}") for n in ("r", "g", "o", "choice", "rl", "gl", "br", "bg", "nr", "ng", "tr", "tg", "said", "first", "or", "og", "plain")}
    wide = F.coalesce(F.size(c["o"]) > 10, F.lit(False))
    listed = lambda alphabet: c["plain"].rlike(rf"^\s*[{alphabet}](\s*,\s*[{alphabet}])+\s*$")
    with_options = F.when(c["rl"].isNotNull() & c["gl"].isNotNull(), c["rl"] == c["gl"]).otherwise((c["or"] != "") & (c["or"] == c["og"]))
    same_text = (c["tr"] != "") & (c["tr"] == c["tg"])
    span = F.when(c["nr"].isNotNull(), F.when(F.size(c["nr"]) == 2, c["nr"])).otherwise(c["first"])
    iou = interval_iou(span[0], span[1], c["ng"][0], c["ng"][1])
    near = F.forall(F.zip_with(c["nr"], c["ng"], lambda a, b: F.abs(a - b) <= SAME_NUMBER), lambda ok: ok)
    rest = (
        F.when(F.size(c["ng"]) == 2, F.when(span.isNotNull(), iou >= IOU_MIN).otherwise(same_text))
        .when(c["nr"].isNotNull() & c["ng"].isNotNull(), (F.size(c["nr"]) == F.size(c["ng"])) & near)
        .when(F.size(c["ng"]) == 1, F.when(c["said"].isNotNull(), F.abs(c["said"] - c["ng"][0]) <= SAME_NUMBER).otherwise(same_text))
        .when(F.size(F.split(c["tg"], " ")) >= LONG_TEXT_WORDS, F.lit(None).cast("boolean"))
        .otherwise(same_text)
    )
    result = (
        F.when(c["r"].isNull() | c["g"].isNull(), F.lit(False))
        .when(listed(LETTERS) | (wide & listed(LETTERS_WIDE)), letter_set(c["r"], wide).eqNullSafe(letter_set(c["g"], wide)))
        .when(c["choice"] & F.coalesce(F.size(c["o"]) > 0, F.lit(False)), with_options)
        .when(c["choice"] & c["br"].isNotNull() & c["bg"].isNotNull(), c["br"] == c["bg"])
        .otherwise(rest)
    )
    return step.withColumn(out, result).select(*[x for x in df.columns if x != out], out)


def question_template(c: Column | str) -> Column:
    """Quoted parts become <ENT>, numbers <NUM>, the rest lower case; repeated placeholders collapse."""
    s = F.regexp_replace(_col(c), "\"[^\"]*\"|“[^”]*”|'[^']*'(?=\\W|$)", "<ENT>")
    s = F.regexp_replace(s, r"\d+(?:[.:,]\d+)*", "<NUM>")
    s = F.regexp_replace(F.lower(s), "<ent>", "<ENT>")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "<num>", "<NUM>"), r"\s+", " "))
    return F.regexp_replace(s, r"(<ENT>|<NUM>)(?:\s\1)+", "$1")


def final_answer(c: Column | str, marker: str = "final answer:", most: int = 300) -> Column:
    """First non-blank line after the last marker (any case), else the last non-blank line; at most ``most`` characters."""
    s = _col(c)
    after = F.try_element_at(F.split(s, f"(?i){marker}"), F.lit(-1))
    lines = lambda t: F.filter(F.transform(F.split(t, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.contains(F.lower(s), F.lit(marker))
    out = F.when(marked, F.try_element_at(lines(after), F.lit(1))).otherwise(F.try_element_at(lines(s), F.lit(-1)))
    return F.substring(out, 1, most)


def gold_contained(reply: Column, gold: Column, most: int = 4) -> Column:
    """Whether a gold of at most ``most`` words stands in the reply as a run of words, both normalised."""
    g, r = norm_text(gold), norm_text(reply)
    return (g != "") & (F.size(F.split(g, " ")) <= most) & F.contains(F.concat(F.lit(" "), r, F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" ")))


def same_wrong(a: Column, b: Column, options: Column | None = None) -> Column:
    """Whether two replies give the same answer: by letters, else by numbers, else by normalised text."""
    la, lb, na, nb = reply_letter(a, options), reply_letter(b, options), numbers(a), numbers(b)
    return F.when(la.isNotNull() & lb.isNotNull(), la == lb).when(na.isNotNull() & nb.isNotNull(), na == nb).otherwise((norm_text(a) != "") & (norm_text(a) == norm_text(b)))


def json_object(c: Column | str) -> Column:
    """The text from the first opening to the last closing brace of a reply, fences ignored; null without one."""
    found = F.regexp_extract(_col(c), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def json_field(c: Column | str, name: str) -> Column:
    """A string or number field of a JSON reply; a truncated object is searched for the field by pattern."""
    whole = F.get_json_object(json_object(c), f"$.{name}")
    loose = F.regexp_extract(_col(c), rf'"{name}"\s*:\s*(?:"([^"]*)|(-?[\d.]+|true|false))', 0)
    value = F.regexp_replace(F.regexp_extract(loose, r":\s*(.*)$", 1), '^"', "")
    return F.coalesce(whole, F.when(loose != "", value))


def english_share(c: Column | str) -> Column:
    """Share of A-Z among all letters; null for a text without letters."""
    letters = F.regexp_count(_col(c), F.lit(r"\p{L}"))
    return F.regexp_count(_col(c), F.lit("[A-Za-z]")) / F.nullif(letters, F.lit(0))


def is_english(c: Column | str, least: float = 0.9) -> Column:
    return F.coalesce(english_share(c) >= least, F.lit(False))


def slug(c: Column | str) -> Column:
    """Lower case with runs of other characters than letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_name(c: Column | str) -> Column:
    """A file name part: anything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9._-]", "_")


def clean_stem(c: Column | str) -> Column:
    """A question without a trailing instruction in parentheses and without surplus blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), r"\s*\([^()]*\)\s*$", ""), r"\s+", " "))
