"""Scores of answers, query expansion by dictionaries, numbers in texts, and alert expressions."""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heads and terms of the two expansion dictionaries.
SYNONYMS = {
    "چیست": ["چیه", "چی", "کدوم", "تعریف", "معنی"],
    "چطور": ["چگونه", "نحوه", "روش", "راه‌حل"],
    "چرا": ["دلیل", "علت", "چرا"],
    "کجا": ["کجاست", "کدام", "کدوم", "مکان", "موقعیت"],
    "کی": ["چه وقت", "زمان", "مقدار", "چه زمانی"],
    "چقدر": ["مقدار", "تعداد", "چند", "چه مقدار"],
    "کدام": ["کدوم", "کیه", "کدامیک"],
    "یادگیری": ["آموزش", "تحصیل", "مطالعه", "فراگیری"],
    "برنامه": ["کد", "نرم‌افزار", "اپلیکیشن", "پروژه"],
    "داده": ["اطلاعات", "معلومات", "دیتا", "اطلاع"],
    "سیستم": ["سامانه", "پلتفرم", "نظام", "ساختار"],
    "مشکل": ["مسئله", "خطا", "ایراد", "اشکال"],
    "راه‌حل": ["حل", "جواب", "پاسخ", "راهکار"],
    "تکنولوژی": ["فناوری", "تکنیک", "روش", "ابزار"],
    "کامپیوتر": ["رایانه", "سیستم", "ماشین", "دستگاه"],
}
RELATED = {
    "یادگیری": ["آموزش", "تحصیل", "مطالعه", "فراگیری", "یاددهی"],
    "برنامه": ["کد", "نرم‌افزار", "اپلیکیشن", "پروژه", "توسعه"],
    "داده": ["اطلاعات", "معلومات", "دیتا", "اطلاع", "آمار"],
    "سیستم": ["سامانه", "پلتفرم", "نظام", "ساختار", "معماری"],
    "مشکل": ["مسئله", "خطا", "ایراد", "اشکال", "باز"],
    "راه‌حل": ["حل", "جواب", "پاسخ", "راهکار", "راه‌اندازی"],
    "تکنولوژی": ["فناوری", "تکنیک", "روش", "ابزار", "تجهیزات"],
    "کامپیوتر": ["رایانه", "سیستم", "ماشین", "دستگاه", "سخت‌افزار"],
    "اینترنت": ["وب", "شبکه", "آنلاین", "دیجیتال", "مجازی"],
    "امنیت": ["حفاظت", "محافظت", "ایمنی", "کنترل", "دسترسی"],
    "پایگاه": ["دیتابیس", "ذخیره", "انبار", "نگهداری", "ذخیره‌سازی"],
    "کاربر": ["مستخدم", "استفاده‌کننده", "کاربری", "شخص", "فرد"],
    "مدیریت": ["کنترل", "نظارت", "هدایت", "رهبری", "سازماندهی"],
    "عملکرد": ["کارایی", "بازدهی", "نتیجه", "خروجی", "تولید"],
    "کیفیت": ["مرغوبیت", "مطلوبیت", "بهبود", "بهینه", "عالی"],
}
#: Stop words of the dictionary's keywords.
STOP = ["چیست", "چطور", "چرا", "کجا", "کی", "چی", "کدوم", "چگونه", "نحوه", "دلیل", "علت", "کجاست", "چه", "وقت", "زمان", "مقدار", "و", "در", "از", "به", "که", "این", "آن", "با", "برای", "است", "بود", "باشد", "می", "خواهد", "کرد", "کرده", "کنم", "کنی", "کند", "کنیم", "کنید", "کنند"]
#: Heads of query categories.
CATEGORIES = {"questions": ["چی", "چطور", "چرا", "کجا", "کی", "کدام"], "commands": ["بگو", "نشان", "بیاور", "پیدا"], "requests": ["لطفا", "می‌تونید", "میشه"]}
#: Phrases that tell of sources, and words that tell of doubt.
SOURCED = ["according to", "based on", "as mentioned", "the document", "the source"]
DOUBT = ["maybe", "perhaps", "might", "could", "possibly", "unclear", "unknown"]
#: Fixed value: years, decimal numbers and pairs of capitalised words.
FACT = r"\b\d{4}\b|\b\d+\.\d+\b|\b[A-Z][a-z]+ [A-Z][a-z]+\b"
NUMBER = r"\d+(?:\.\d+)?"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def count_words(text: Column) -> Column:
    return F.size(word_list(text))


def held(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases a text holds, in any case."""
    return reduce(lambda a, b: a + b, [F.contains(F.lower(text), F.lit(p)).cast("int") for p in phrases])


def keywords(query: Column) -> Column:
    """Words of a query that are no stop words and have two characters at least."""
    return F.filter(word_list(query), lambda w: ~w.isin(*STOP) & (F.length(w) > 1))


def first_replaced(query: Column, head: str, term: str) -> Column:
    """The query with the first place of a head replaced."""
    at = F.locate(head, query)
    return F.concat(F.substring(query, F.lit(1), at - 1), F.lit(term), F.substring(query, at + len(head), F.length(query)))


def related(query: Column, dictionary: dict[str, list[str]] = RELATED) -> Column:
    """Variants of a query: for each head among its keywords, in order of the dictionary, a variant for each term."""
    own = keywords(query)
    return F.flatten(F.array(*[F.when(F.array_contains(own, head), F.array(*[first_replaced(query, head, t) for t in terms])).otherwise(F.array().cast("array<string>")) for head, terms in dictionary.items()]))


def category(query: Column) -> Column:
    out = F.lit("other")
    for name, heads in reversed(CATEGORIES.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.startswith(F.lower(query), F.lit(h)) for h in heads]), name).otherwise(out)
    return out


def accuracy(answer: Column, question: Column) -> Column:
    asked = count_words(question)
    expected = F.when(asked < 5, 20).when(asked < 10, 50).otherwise(100)
    score = F.least(count_words(answer) / expected, F.lit(1.0)) * 0.7 + held(answer, SOURCED) / len(SOURCED) * 0.3
    return F.when((F.length(answer) > 0) & (F.length(question) > 0), score).otherwise(0.0)


def factual_overlap(answer: Column, context: Column) -> Column:
    """Share of the context's facts, repeats counted, that are in the answer; one half where there are none."""
    facts = lambda text: F.regexp_extract_all(text, F.lit(FACT), F.lit(0))
    share = F.size(F.array_intersect(facts(context), facts(answer))) / F.size(facts(context))
    return F.when((F.length(answer) == 0) | answer.isNull(), 0.0).when(F.size(facts(context)) == 0, 0.5).otherwise(F.least(share, F.lit(1.0)))


def confidence(answer: Column, documents: Column, quality: Column) -> Column:
    n = count_words(answer)
    length = F.when(n < 5, 0.3).when(n > 200, 0.8).otherwise(1.0)
    doubt = F.greatest(F.lit(0.5), 1.0 - held(answer, DOUBT) * 0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality * 0.4 + F.least(documents / 5, F.lit(1.0)) * 0.3 + length * 0.2 + doubt * 0.1))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)).cast("array<double>")


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)


def sentiment(values: Column) -> Column:
    """bullish or bearish where the last three of five numbers or more lie 5 per cent above or below the others."""
    late, early = mean(F.slice(values, -3, 3)), mean(F.slice(values, F.lit(1), F.greatest(F.size(values) - 3, F.lit(1))))
    return F.when(F.size(values) < 5, "neutral").when(late > early * 1.05, "bullish").when(late < early * 0.95, "bearish").otherwise("neutral")


def alert(expression: str, names: list[str]) -> Column:
    """A condition over columns from an expression of comparisons (chained ones too), arithmetic, and, or, not.

    Anything else, an unknown name too, makes the condition false."""

    def value(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() as x):
                return F.lit(x)
            case ast.Name(id=name) if name in names:
                return F.col(name)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~value(x)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.BoolOp(op=op, values=parts):
                return reduce((lambda a, b: a & b) if isinstance(op, ast.And) else (lambda a, b: a | b), map(value, parts))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](value(a), value(b))
            case ast.Compare(left=first, ops=ops, comparators=others) if all(type(o) in _COMPARISONS for o in ops):
                sides = [value(first), *map(value, others)]
                return reduce(lambda a, b: a & b, [_COMPARISONS[type(o)](a, b) for o, a, b in zip(ops, sides, sides[1:], strict=False)])
        raise ValueError(ast.dump(node))

    try:
        return F.coalesce(value(ast.parse(expression, mode="eval").body).cast("boolean"), F.lit(False))
    except (ValueError, SyntaxError):
        return F.lit(False)


_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}
_COMPARISONS = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def scored_by(rows: DataFrame, score: Callable[[dict[str, Column]], Column], name: str = "score") -> DataFrame:
    """Rows with a caller's own score of their columns."""
    return rows.withColumn(name, score({c: F.col(c) for c in rows.columns}))
