"""Text scalars as Column functions: clean-up, clause numbers, normal forms, stems, token sets, similarity terms."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Beginnings of action verbs and nouns in Russian regulations.
ACTION_ROOTS = (
    "осуществл", "обеспеч", "провод", "провед", "контрол", "провер", "разрабатыв", "разработ", "согласов", "согласу", "утвержд", "организ",
    "отвеча", "формир", "оценив", "оценк", "подгот", "готов", "выполн", "координир", "расслед", "консульт", "взаимодейств", "анализир",
    "представл", "запрашив", "вынос", "внос", "инициир", "актуализир", "консолидир", "участв", "участи", "содейств", "использ", "выявл",
    "определ", "предлаг", "получ", "присутств", "довод", "вести", "ведет", "ведут", "ведение", "копир", "опечат", "изуч", "пользов",
    "расшир", "требов", "информир", "руковод", "соблюд", "придержив", "оказыв", "приним", "подписыв", "раскрыв", "внедр", "создан",
    "созда", "хран", "обработ", "веден", "мониторинг", "аудит",
)
# Roots that stand for one action, with their common form.
CANONICAL_ROOTS = (("готов", "подгот"), ("подгот", "подгот"), ("провед", "провод"), ("согласу", "соглас"), ("согласов", "соглас"))
# Endings that a stem drops, in the order in which they are tried; four letters must remain.
ENDINGS = (
    "иями", "ями", "ами", "ого", "ему", "ому", "ыми", "ими", "иях", "ия", "ие", "ии", "ий", "ый", "ая", "ое", "ые", "ой", "ей", "ых", "их",
    "ов", "ев", "ам", "ям", "ах", "ях", "ом", "ем", "ую", "юю", "а", "я", "ы", "и", "у", "ю", "е",
)
# Words without weight in a comparison of duties.
STOP_WORDS = (
    "и в во на по с со для от до из за при а или его ее их это том числе общества компании организации соответствии настоящего положения "
    "функций функции работы деятельность деятельности рамках части внутреннего внутренних аудита бва вопросам отношении который которые "
    "также осуществляет обеспечивает проводит выполняет"
).split()
# Objects too general to tell two processes apart.
GENERAL_OBJECTS = ("систем", "работ", "процесс", "план", "результат", "информац", "организ")

# Words without weight when passages are looked up.
RETRIEVAL_STOP_WORDS = (
    "которые который которая настоящего положения общества осуществляет осуществляют подразделения подразделение работники работников "
    "соответствии целях также является должны должен имеет права функции работа работы"
).split()
# Verb forms (third person) that make a clause a duty, and words of obligation, right and prohibition.
FINITE_FORMS = (
    "осуществля(?:ет|ют)", "обеспечива(?:ет|ют)", "провод(?:ит|ят)", "контролиру(?:ет|ют)", "проверя(?:ет|ют)", "разрабатыва(?:ет|ют)",
    "согласовыва(?:ет|ют)", "утвержда(?:ет|ют)", "вед[её]т", "ведут", "организу(?:ет|ют)", "отвеча(?:ет|ют)", "формиру(?:ет|ют)",
    "оценива(?:ет|ют)", "подготавлива(?:ет|ют)", "готов(?:ит|ят)", "выполня(?:ет|ют)", "координиру(?:ет|ют)", "взаимодейству(?:ет|ют)",
    "анализиру(?:ет|ют)", "представля(?:ет|ют)", "запрашива(?:ет|ют)", "вынос(?:ит|ят)", "участву(?:ет|ют)", "консолидиру(?:ет|ют)",
    "актуализиру(?:ет|ют)", "консультиру(?:ет|ют)", "иницииру(?:ет|ют)", "соблюда(?:ет|ют)", "хран(?:ит|ят)",
)
MODAL_FORMS = ("не\\s+име(?:ет|ют)\\s+прав[ао]", "име(?:ет|ют)\\s+право", "обязан[аы]?", "долж(?:ен|ны|на)", "вправе", "запрещено")
# Words that begin a unit's name, and phrases that open a list of units.
UNIT_WORDS = ("департамент", "отдел", "управление", "служба", "сектор", "центр", "бюро", "блок", "комитет")
STRUCTURE_PHRASES = ("состоит\\s+из", "следующ\\w*\\s+структурн\\w*\\s+подразделени", "в\\s+структуру.+вход", "структура.+включа")
# Duties too general to be told apart.
GENERIC_DUTIES = (
    "прочих поручени", "организу\\w* работу (?:днм|дккм|департамент|отдел|центр)", "повышени\\w* профессионального уровня",
    "по всему кругу вопросов", "участву\\w* в разработке (?:внд|проектов документации)",
)
# How a norm form abbreviates, what a text says of norms and of roles.
LONG_NAMES = (("проект(?:ов|ы)? документации,? регламентирующей работу бва", "внд бва"), ("внутренних нормативных документов", "внд"))
PROHIBITION, RIGHT, DUTY = r"не\s+име(?:ет|ют)\s+прав|запрещ", r"име(?:ет|ют)\s+право|\bвправе\b", r"\bобязан[аы]?\b|\bдолж(?:ен|на|ны)\b"
FIRST_WORDS = (
    ("agree", r"обсуждени\w* и согласовани"), ("control", r"(?:провер|контрол|оценив|оценк|аудит|мониторинг)|(?:провод|провед)\w*\s+(?:аудит|провер|оценк)"),
    ("approve", "утвержд"), ("agree", "соглас"), ("participate", "участ|содейств"), ("coordinate", "организ|координир|руковод"),
)
# Wording that claims a cause, and the characters that Markdown reads as marks.
CAUSAL = r"(?iU)привел[оаи]?\s+к|вызвал[оаи]?|благодаря"
MARKDOWN_MARKS = "\\`*_[]#|!"

NUMBERING = r"^\s*(\d+(?:\.\d+)*)(?:\.|\))?\s*"
LETTERING = r"(?iu)^\s*([а-яa-z])[.)]\s+"
FINITE = r"(?iU)\b(?:" + "|".join(FINITE_FORMS) + r")\b"
MODAL = r"(?iU)\b(?:" + "|".join(MODAL_FORMS) + r")\b"
ACTION = r"(?iU)\b(?:" + "|".join(ACTION_ROOTS) + r")[а-яё]*\b"


def clean(text: Column) -> Column:
    """White space of any kind collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clause(text: Column) -> Column:
    """The clause number at the start ("5.3.1"), else an empty string."""
    return F.regexp_extract(text, NUMBERING, 1)


def body(text: Column) -> Column:
    """Text without its clause number, list letter and bullets."""
    plain = F.regexp_replace(F.regexp_replace(text, NUMBERING, ""), LETTERING, "")
    return F.regexp_replace(plain, r"^[ •–—\t]+|[ •–—\t]+$", "")


def norm(text: Column) -> Column:
    """Lower case, ё as е, two long names abbreviated, only words of letters and digits."""
    t = F.regexp_replace(F.lower(text), "ё", "е")
    for long, short in LONG_NAMES:
        t = F.regexp_replace(t, long, short)
    return F.array_join(F.regexp_extract_all(t, F.lit("[а-яa-z0-9]+"), 0), " ")


def stem(word: Column) -> Column:
    """One word's stem: common form of a root, an action root of five letters, or the word without the first ending that fits."""
    out = F.when(F.lit(False), word)
    for root, form in CANONICAL_ROOTS:
        out = out.when(word.startswith(root), form)
    none = F.lit("")
    root = F.nullif(F.regexp_extract(word, "^(?:" + "|".join(r for r in ACTION_ROOTS if len(r) >= 5) + ")", 0), none)
    short = F.nullif(F.regexp_extract(word, "^(.{4,}?)(?:" + "|".join(ENDINGS) + ")$", 1), none)
    return out.otherwise(F.coalesce(root, short, word))


def tokens(text: Column) -> Column:
    """The set of stems of a text's words: over two letters, no stop word, no number; sorted."""
    words = F.filter(F.split(norm(text), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS) & ~w.rlike(r"^\d+$"))
    return F.array_sort(F.array_distinct(F.transform(words, stem)))


def actions(text: Column) -> Column:
    """The set of stems of action words."""
    found = F.regexp_extract_all(text, F.lit(ACTION), 0)
    return F.array_distinct(F.transform(found, lambda w: stem(F.regexp_replace(F.lower(w), "ё", "е"))))


def before(text: Column, pattern: str) -> Column:
    """How many characters stand before the first match of pattern; null without one."""
    return F.when(text.rlike(pattern), F.length(F.regexp_extract(text, rf"(?s)\A(.*?)(?:{pattern})", 1)))


def first_action(text: Column) -> Column:
    """struct(at, stem) of the first action word; at counts characters before it, null without one."""
    word = F.nullif(F.regexp_extract(text, ACTION, 0), F.lit(""))
    return F.struct(before(text, ACTION).alias("at"), stem(F.regexp_replace(F.lower(word), "ё", "е")).alias("stem"))


def norm_type(text: Column, inherited: Column) -> Column:
    """prohibition, right, duty, or what the context gives."""
    head = F.coalesce(F.substr(text, F.lit(1), before(text, ACTION)), text)
    return (
        F.when(text.rlike(rf"(?iU){PROHIBITION}|\bне\s+(?:" + "|".join(ACTION_ROOTS) + ")"), "prohibition")
        .when(text.rlike(rf"(?iU){RIGHT}"), "right")
        .when(head.rlike(rf"(?iU){DUTY}"), "duty")
        .otherwise(inherited)
    )


def role(text: Column) -> Column:
    """What an owner does with the object, by the first words."""
    t, out = norm(body(text)), F.when(F.lit(False), "")
    for name, words in FIRST_WORDS:
        out = out.when(t.rlike(rf"(?U)\A(?:{words})"), name)
    return out.otherwise("execute")


def stems(text: Column) -> Column:
    """The stems of all words in order, with a space before, between and after: a phrase is in a text if its stems are."""
    return F.concat(F.lit(" "), F.array_join(F.transform(F.split(norm(text), " "), stem), " "), F.lit(" "))


def unit_name(text: Column) -> Column:
    """A unit's name as a heading or a clause gives it: up to a bracket, a stop, a dash or the predicate."""
    t = F.get(F.split(text, r"\(|[;:.]|\s+[—–]\s"), 0)
    t = F.substr(t, F.lit(1), F.coalesce(before(t, FINITE), before(t, MODAL), F.length(t)))
    t = F.regexp_replace(t, r"(?iU)\s+не\s*$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^[ ,.\-–—]+|[ ,.\-–—]+$", ""), r"(?U)\s+", " ")


def split_actions(text: Column) -> Column:
    """Coordinated predicates apart: at semicolons, and before each verb form but a part's first that a comma or "и" connects."""
    cut = "\x01"
    connected = rf"(?iU)((?:,\s*|\s+и\s+))(?={FINITE.removeprefix('(?iU)')})"

    def of(part: Column) -> Column:
        pieces = F.split(F.regexp_replace(part, connected, f"{cut}$1"), cut)
        first = F.when(F.get(pieces, 0).rlike(FINITE), pieces)
        joined = F.concat(F.array(F.concat(F.get(pieces, 0), F.coalesce(F.get(pieces, 1), F.lit("")))), F.slice(pieces, 3, F.greatest(F.size(pieces) - 2, F.lit(0))))
        out = F.coalesce(first, F.when(F.size(pieces) > 1, joined), pieces)
        return F.transform(out, lambda x, i: F.regexp_replace(F.when(i > 0, F.regexp_replace(x, r"^(?:,\s*|\s+и\s+)", "")).otherwise(x), r"^[ ,;]+|[ ,;]+$", ""))

    return F.filter(F.flatten(F.transform(F.split(text, r";\s*"), of)), lambda x: x != "")


def is_generic(text: Column) -> Column:
    """Whether a duty is too general for two owners of it to be told apart."""
    return norm(text).rlike("(?U)" + "|".join(GENERIC_DUTIES))


def possible_abbreviation(old: Column, new: Column, old_tokens: Column, new_tokens: Column) -> Column:
    """Whether the new wording is a short form of the old one: one first action, two to four tokens, three quarters of them shared."""
    a, b = first_action(old)["stem"], first_action(new)["stem"]
    n = F.size(new_tokens)
    return F.coalesce((a == b) & n.between(2, 4) & (F.size(old_tokens) > n) & (F.size(F.array_intersect(old_tokens, new_tokens)) >= 0.75 * n), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared part of the smaller of two sets; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def _ratios(a: list[str], b: list[str], least: list[float]) -> list[float | None]:
    """difflib's ratio of each pair, or None where it is under `least`.

    Lengths and counts of letters bound the ratio from above; pairs whose bound is too low are not aligned. Equal pairs
    are aligned once, and pairs with one second string share its index.
    """
    need: dict[tuple[str, str], float] = {}
    for x, y, n in zip(a, b, least, strict=True):
        need[x, y] = min(n, need.get((x, y), n))
    letters: dict[str, Counter] = {}
    for s in {s for pair in need for s in pair}:
        letters[s] = Counter(s)
    matcher, known, second = SequenceMatcher(None), {}, None
    for x, y in sorted(need, key=lambda p: (p[1], p[0])):
        total, n = len(x) + len(y), need[x, y] - 1e-9
        if not total or x == y:
            known[x, y] = 1.0
        elif 2 * min(len(x), len(y)) < n * total or 2 * (letters[x] & letters[y]).total() < n * total:
            known[x, y] = None
        else:
            if y != second:
                matcher.set_seq2(y)
                second = y
            matcher.set_seq1(x)
            known[x, y] = matcher.ratio()
    return [r if (r := known[x, y]) is not None and r >= n - 1e-9 else None for x, y, n in zip(a, b, least, strict=True)]


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """difflib's ratio of two strings, null where it is under `least`; the only term that no built-in function gives."""
    return pd.Series(_ratios(a.tolist(), b.tolist(), least.tolist()), dtype="float64")


def similarity(a: Column, b: Column, ta: Column, tb: Column, least: float | Column = 0.0) -> Column:
    """1 for equal normal forms a, b; else .55 Jaccard + .25 containment + .20 sequence ratio of the sorted token sets; 0 if a set is empty.

    Where that is under `least`, it may be what it is or the sum without the last term: letters are aligned only where
    the first two terms leave the sum a chance.
    """
    plain = 0.55 * jaccard(ta, tb) + 0.25 * containment(ta, tb)
    need = (F.lit(least) - plain) / 0.20
    known = (a == b) | (F.size(ta) == 0) | (F.size(tb) == 0) | (need > 1 + 1e-9)
    text = lambda t: F.when(known, "").otherwise(F.array_join(t, " "))
    mixed = plain + 0.20 * F.coalesce(sequence_ratio(text(ta), text(tb), F.when(known, 0.0).otherwise(need)), F.lit(0.0))
    return F.when(a == b, 1.0).when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).when(known, plain).otherwise(mixed)


# Units that a label may give in brackets or at its end.
LABEL_UNITS = r"%|шт\.?|ед\.?|дн\.?|дней|чел\.?|fte|балл\w*"


def label_key(text: Column) -> Column:
    """A metric label's key: lower case, ё as е, no unit of measure in brackets or after a last comma or semicolon, words only."""
    t = F.translate(F.lower(text), "ё", "е")
    t = F.regexp_replace(F.regexp_replace(t, rf"(?U)\((?:{LABEL_UNITS})\)", " "), rf"(?U)[,;]\s*(?:{LABEL_UNITS})\s*$", "")
    return F.array_join(F.regexp_extract_all(t, F.lit("[а-яa-z0-9]+"), 0), " ")


def retrieval_tokens(text: Column, letters: str = "а-яёa-z") -> Column:
    """Words of four letters or more without stop words, cut to nine, as a sorted set."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"[{letters}]{{4,}}"), 0)
    kept = F.filter(found, lambda w: ~w.isin(*RETRIEVAL_STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 9))))


def markdown_safe(text: Column) -> Column:
    """Control characters dropped, marks of Markdown escaped, angle brackets and ampersands as entities."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return F.regexp_replace(t, "([" + "".join("\\" + c for c in MARKDOWN_MARKS) + "])", r"\\$1")


def clip(text: Column, size: int) -> Column:
    """At most size characters, the last three of a longer text as dots."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 3), F.lit("...")))


def plain_text_ok(text: Column, most: int = 3000) -> Column:
    """Whether a model's wording can be shown: not blank, not too long, no claim of a cause."""
    return F.coalesce((F.trim(text) != "") & (F.length(text) <= most) & ~text.rlike(CAUSAL), F.lit(False))
