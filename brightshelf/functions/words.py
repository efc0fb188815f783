"""Word lists and character tables of query processing."""

# Every list and table of this module must hold exactly these entries for results to be the expected ones.

STOP_WORDS = (
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то",
    "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же", "вы", "за",
    "бы", "по", "только", "её", "ее", "мне", "было", "вот", "от", "меня", "ещё",
    "нет", "о", "из", "ему", "теперь", "когда", "уже", "вам", "ни", "быть", "был",
    "для", "мы", "их", "без", "том", "более", "всего",
)

LONG_STOP_WORDS = (
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то",
    "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же", "вы", "за",
    "бы", "по", "только", "её", "ее", "мне", "было", "вот", "от", "меня", "ещё",
    "нет", "о", "из", "ему", "теперь", "когда", "уже", "вам", "ни", "быть", "был",
    "него", "до", "вас", "нибудь", "опять", "уж", "ведь", "там", "потом",
    "себя", "ничего", "ей", "может", "они", "тут", "где", "есть", "надо", "ней",
    "для", "мы", "тебя", "их", "чем", "была", "сам", "чтоб", "без", "будто",
    "чего", "раз", "тоже", "себе", "под", "будет", "ж", "тогда", "кто", "этот",
    "того", "потому", "этого", "какой", "совсем", "ним", "здесь", "этом", "один",
    "почти", "мой", "тем", "чтобы", "нее", "сейчас", "были", "куда", "зачем",
    "всех", "можно", "при", "над", "чуть", "том", "такой", "им", "более", "всего",
)

#: The same keys in the Latin and in the Russian keyboard layout.
LATIN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,./"
RUSSIAN_KEYS = "йцукенгшщзхъфывапролджэячсмитьбю."

#: Endings in the order in which they are tried, which is not that of their lengths.
ENDINGS = (
    "ами", "ями", "ого", "его", "ому", "ему", "ой", "ей", "ию",
    "ии", "ия", "ие", "ье", "ья", "ов", "ев",
    "ими", "ыми", "ую", "юю",
    "ая", "яя", "ое", "ее", "ий", "ый",
    "ешь", "ете", "ить", "ать", "ять", "уть",
    "ет", "ит", "ут", "ют", "ал", "ил", "ел",
    "ах", "ях", "ом", "ем", "ам", "ям", "ых", "их",
    "ы", "и", "а", "я", "у", "ю", "о", "е", "ь",
)

#: Latin groups of letters to Cyrillic, longest first.
TO_CYRILLIC_GROUPS = (("sch", "щ"), ("yo", "ё"), ("zh", "ж"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"))
TO_CYRILLIC_LETTERS = ("abvgdezijklmnoprstufhywq", "абвгдэзийклмнопрстуфхывк")
TO_CYRILLIC_LAST = (("x", "кс"),)
#: Cyrillic letters to Latin; a letter not listed stays.
TO_LATIN_LETTERS = ("абвгдэзийклмнопрстуфхы", "abwgdezijqlmnoprstufhy")
TO_LATIN_GROUPS = (("ё", "yo"), ("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ю", "yu"), ("я", "ya"))

KNOWN_BRANDS = ("nike", "adidas", "puma", "reebok", "samsung", "apple", "iphone", "huawei", "xiaomi", "sony", "lg", "bosch")
#: Values that mean yes in a feed, and in a stock update.
TRUE_WORDS = ("true", "1", "yes", "в наличии", "available")
STOCK_WORDS = ("true", "1", "yes", "в наличии")
