"""Words and names that queries are read with."""

from __future__ import annotations

# Words and names that give the right results. They stand in the order in which they apply.

PHRASE_FILLERS = [
    "نشونم بده", "نشانم بده", "بهم نشون بده", "برام نشون بده", "رو نشون بده", "رو نشان بده", "نشون بده", "نشان بده",
    "چی موجوده", "چی دارید", "چی دارین", "برای من", "به من", "می خواهم", "می خوام", "میخواستم", "می خواستم", "پیدا کن", "سفارش بدم", "چند تا",
]

TOKEN_FILLERS = [
    "میخوام", "میخواهم", "میخواستم", "لطفا", "لطفاً", "برام", "بهم", "رو", "را", "محصولات", "محصول", "کالاها", "کالا", "نشون", "نشان",
    "بده", "بدهید", "بدین", "از", "چی", "چیز", "چیزی", "موجوده", "موجود", "دارید", "دارین", "داره", "دارم", "هست", "هستن", "باشه",
    "کن", "کنه", "کنید", "کنین", "میشه", "میتونم", "میتوانم", "یه", "این", "اون", "هم", "ولی", "اما", "که", "تو", "در", "برای", "من",
    "ما", "شما", "بخرم", "بخریم", "بدم", "ببینم", "ببین", "آیا", "اگر", "فقط", "همه", "اینا", "ممنون", "مرسی", "سلام", "برند", "های",
    "ها", "کدوم", "کدومش", "چندتا", "چند", "واسه", "کجاست", "چطوره", "چنده", "چیه", "چیست", "کیه", "بگو", "بگید", "بگین",
    "products", "product", "please", "show",
]

SOFT_TOKENS = ["کردن", "یا", "و", "حاوی", "مناسب", "خیلی", "خوب", "بهتر", "بهترین", "سی", "c"]
CONSTRAINT_TOKENS = ["زیر", "بالای", "بالا", "بین", "میلیون", "هزار", "تومن", "تومان", "صد", "ده", "بیست", "یک"]
PRICE_TOKENS = ["هزار", "میلیون", "تومان", "تومن", "هزارتومان", "هزارتومن", "زیر", "بالای", "بالا", "بین"]
PHRASE_EXTENDERS = ["ماسک", "تثبیت", "ناخن", "ویتامین"]
NUMBER_WORDS = {"یک": 1, "دو": 2, "سه": 3, "ده": 10, "بیست": 20, "صد": 100}

BRANDS = {
    "Salute": ["سالوته", "سالوت", "salute"],
    "Xiaomi": ["شیائومی", "xiaomi"],
    "Note": ["نوت", "note"],
    "NICE PUPPET": ["نایس پاپت", "nice puppet"],
    "Citray": ["سیترای", "citray"],
    "Super Kay": ["سوپر کی", "super kay"],
    "Bright Max": ["برایت مکس", "bright max"],
    "Defacto": ["دیفکتو", "defacto"],
    "prime": ["پرایم", "prime"],
    "Signature": ["سیگنیچر", "signature"],
    "Woody Sence": ["وودی سنس", "woody sence", "woody sense"],
    "Seniorita": ["سنیوریتا", "seniorita"],
    "Dafi": ["دافی", "dafi"],
    "RODIER": ["رودیر", "rodier"],
    "Rang Ta Rang": ["رنگ تا رنگ", "rang ta rang"],
    "Merida": ["مریدا", "merida"],
    "Noyer": ["نویر", "noyer"],
    "Vitalayer": ["ویتالیر", "vitalayer"],
    "Sclaree": ["اسکلاره", "sclaree"],
    "Cinere": ["سینره", "cinere"],
    "JUXI": ["ژاکسی", "juxi"],
    "Heritage": ["هریتیج", "heritage"],
    "Hello Fresh": ["هلو فرش", "hello fresh"],
    "Troya": ["ترویا", "تریا", "troya"],
}

CATEGORIES = [
    ("کیف لوازم آرایشی", "کیف لوازم آرایشی"),
    ("رژ لب مایع", "رژ لب مایع"),
    ("رژ لب جامد", "رژ لب جامد"),
    ("مام ضد تعریق", "مام"),
    ("کرم ضد آفتاب", "کرم ضدآفتاب"),
    ("کرم ضدآفتاب", "کرم ضدآفتاب"),
    ("ضدآفتاب", "کرم ضدآفتاب"),
    ("عطر جیبی", "عطر جیبی"),
    ("عطر زنانه", "عطر"),
    ("لاک ناخن", "لاک ناخن"),
    ("خط چشم", "خط چشم"),
    ("ماسک مو", "ماسک مو"),
    ("دستمال مرطوب", "دستمال مرطوب"),
    ("ماشین اصلاح", "ماشین اصلاح"),
    ("شوینده صورت", "شوینده صورت"),
    ("کرم دست", "کرم دست"),
    ("رنگ مو", "رنگ مو"),
    ("رژگونه", "رژگونه"),
    ("ماساژور", "ماساژور"),
    ("پنکک", "پنکک"),
    ("مسواک", "مسواک"),
    ("کانسیلر", "کانسیلر"),
]

COLORS = ["مشکی", "سفید", "طوسی", "خاکستری", "قرمز", "آبی", "سبز", "صورتی", "طلایی", "نقره ای", "بنفش", "قهوه ای", "نارنجی"]
MATERIALS = ["چرم", "کتان", "پنبه", "ابریشم", "پلاستیک", "فلزی"]
GENDERS = ["زنانه", "مردانه", "دخترانه", "پسرانه"]

NEGATIVE_PREFIXES = [r"بدون\s+برند", r"به\s+جز\s+برند", r"غیر\s+از\s+برند", "بدون", r"به\s+جز", r"غیر\s+از"]
COLLOQUIAL = "یه چیزی|یه دونه|یه مدل|نمیخوام خیلی|گرون نباشه|خوب باشه|چی پیشنهاد|پیشنهاد میدی|نمی دونم|نمیدونم"
IMPLICIT_USE = r"برای\s+\S+|مناسب\s+\S+|موهای|گردن|صورت|خشک|چرب|حساس"
IMPLICIT_PRICE = "گرون|گران|ارزان|ارزون|بودجه|قیمت مناسب"
QUALITY = r"خوب|بهترین|بهتر(?![\p{L}\p{N}_])"
COMPLEX_INTENT = r"ولی|اما|همچنین|هم\s+|نه خیلی|ترجیح"

# End of the fixed values.


def brand_aliases(brands: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(key, canonical) in the order of the dictionary; the canonical name comes first and a key counts once."""
    out: dict[str, str] = {}
    for canonical, aliases in (BRANDS if brands is None else brands).items():
        for alias in (canonical, *aliases):
            out.setdefault(alias.replace("‌", "").strip().lower(), canonical)
    return list(out.items())


def longest_first(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(pairs, key=lambda p: -len(p[0]))


def same(names: list[str]) -> list[tuple[str, str]]:
    return [(n, n) for n in names]
