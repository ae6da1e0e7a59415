"""Values that results depend on and that are therefore fixed, in one place."""

# The 31 letters, and the two accented vowels that are correct spelling.
LETTERS = "абвгдѓежзѕијклљмнњопрстќуфхцчџш"
ACCENTED = "ѐѝ"

# Latin characters that look like a Macedonian letter.
LOOKALIKES = {
    "a": "а", "c": "с", "e": "е", "è": "ѐ", "È": "Ѐ", "ì": "ѝ", "Ì": "Ѝ", "j": "ј", "o": "о", "p": "р", "s": "ѕ", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У",
}

# Lower-case Cyrillic letters of other languages; capitals follow by capitalising.
FOREIGN = {
    "ђ": "ѓ", "ћ": "ќ", "ё": "е", "ъ": "", "ы": "и", "э": "е", "я": "ја", "ю": "ју", "щ": "шт", "ь": "", "і": "и", "ї": "ји", "є": "е", "ґ": "г",
}

# Latin sequences and the letters they stand for, in order, then further readings.
LATIN = [
    ("dzh", "џ"), ("dž", "џ"), ("zh", "ж"), ("ž", "ж"), ("ch", "ч"), ("č", "ч"), ("sh", "ш"), ("š", "ш"), ("gj", "ѓ"), ("gy", "ѓ"), ("dj", "ѓ"), ("đ", "ѓ"), ("ǵ", "ѓ"),
    ("kj", "ќ"), ("ky", "ќ"), ("ć", "ќ"), ("ḱ", "ќ"), ("dz", "ѕ"), ("lj", "љ"), ("nj", "њ"), ("ts", "ц"),
    ("a", "а"), ("b", "б"), ("v", "в"), ("g", "г"), ("d", "д"), ("e", "е"), ("z", "з"), ("i", "и"), ("j", "ј"), ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"),
    ("p", "п"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("f", "ф"), ("h", "х"), ("c", "ц"), ("w", "в"), ("q", "к"), ("x", "кс"), ("y", "ј"),
]
LATIN_MORE = [("c", "к"), ("j", "џ"), ("y", "и"), ("x", "х")]
MAX_READINGS = 64

# Serbian words and the Macedonian ones to use.
SERBIAN = {
    "боље": "подобро", "ваздух": "воздух", "ваљда": "веројатно", "вероватно": "веројатно", "вожња": "возење", "вожњата": "возењето", "где": "каде", "године": "години",
    "данас": "денес", "детаљи": "детали", "дешава": "случува", "допринесе": "придонесе", "доручек": "појадок", "доручекот": "појадокот", "заправо": "всушност", "зато": "затоа",
    "иначе": "инаку", "ипак": "сепак", "искључиво": "исклучиво", "јер": "бидејќи", "јуче": "вчера", "кашика": "лажица", "лопови": "крадци", "људи": "луѓе", "много": "многу",
    "можда": "можеби", "нажалост": "за жал", "највероватно": "најверојатно", "наравно": "секако", "насеље": "населба", "некад": "некогаш", "никад": "никогаш", "ништа": "ништо",
    "новчаник": "паричник", "обавезно": "задолжително", "одмах": "веднаш", "позориште": "театар", "понаша": "однесува", "потрошња": "потрошувачка", "потрошњата": "потрошувачката",
    "радник": "работник", "рецимо": "на пример", "сватив": "сфатив", "свашта": "сешто", "становништво": "население", "сутра": "утре", "тамо": "таму", "тањир": "чинија", "тачно": "точно",
    "увек": "секогаш", "уље": "масло", "уназад": "наназад", "унапред": "однапред", "уопште": "воопшто", "уствари": "всушност", "утакмица": "натпревар", "утакмицата": "натпреварот",
    "утакмици": "натпревари", "хвала": "благодарам", "хлеб": "леб",
}

# Letters that are easily typed for one another.
CONFUSED = ["кќ", "гѓ", "сѕ", "зѕ", "џч", "еѐ", "иѝ", "оу"]

# Limits of the spelling rules.
MAX_SUGGESTIONS, MIN_LATIN, MAX_ACRONYM, MAX_QUERY = 5, 3, 5, 32

# Word lists of the grammar rules.
SUBJECTS = ["јас", "ти", "тој", "таа", "тоа", "ние", "вие", "тие"]
NE_EXCEPTED = ["нестан", "непогод"]
ABBREVIATIONS = ["итн", "др", "сл", "пр", "тн"]
OPENERS = ["„", '"', "«", "'", "‘"]
CLOSERS = [",", ".", "!", "?", ":", ";", "…", "”", "’", ")"]
TIME_NOUNS = [
    "ден", "ноќ", "утро", "вечер", "пладне", "попладне", "недела", "седмица", "месец", "година", "лето", "зима", "пролет", "есен", "викенд", "век", "време", "час",
    "минута", "секунда", "понеделник", "вторник", "среда", "четврток", "петок", "сабота", "празник", "сезона", "пат",
]

# Rule id, place among equal spans, group, name, description, message.
RULES = [
    ("MK_SPELL", 0, "Правопис", "Правопис", "Непознат збор, со предлози за исправка.", "Непознат збор."),
    ("MK_HOMOGLYPH", 0, "Правопис", "Измешани писма", "Латинични букви скриени во кирилички збор.", "Зборот меша латинични и кирилични букви што изгледаат исто."),
    ("MK_FOREIGN_CYRILLIC", 0, "Правопис", "Странски кирилични букви", "Букви што ги нема во македонската азбука (ђ, ъ, щ…).", "Зборот содржи букви што не постојат во македонската азбука."),
    ("MK_LATIN_TEXT", 0, "Правопис", "Текст на латиница", "Македонски пишуван со латински букви.", "Изгледа дека зборот е напишан со латиница."),
    ("MK_SERBIANISM", 0, "Стил", "Србизми", "Српски збор наместо македонски: увек → секогаш.", "Српски збор; на македонски: {}."),
    ("MK_DOUBLE_DEFINITE", 1, "Граматика", "Двоен член", "Членот е означен двапати: убавата книгата.", "Членот се пишува само на првиот збор во именската група."),
    ("MK_CLITIC_ORDER", 2, "Граматика", "Ред на клитики", "Дативната клитика стои пред акузативната: ми го, не го ми.", "Заменките се пишуваат: дативна пред акузативна (ми го, не го ми)."),
    ("MK_DATIVE_I", 3, "Граматика", "ѝ наспроти и", "Дативната заменка ѝ со гравис, за разлика од сврзникот и.", "Дативната заменка ѝ се пишува со гравис, за разлика од сврзникот и."),
    ("MK_L_PARTICIPLE", 4, "Граматика", "Л-партицип", "Партиципот се сложува со подметот: таа дошла, не дошол.", "Л-партиципот мора да се сложува со подметот во род и број."),
    ("MK_NE_FUSED", 5, "Граматика", "Слеано не", "Негацијата стои одвоено од глаголот: не сака, не несака.", "Негацијата не се пишува слеано со глаголот."),
    ("MK_NAJ_SEPARATED", 6, "Граматика", "Разделено нај", "Нај се пишува слеано: најдобар, не нај добар.", "Нај се пишува слеано со зборот што го степенува."),
    ("MK_SENTENCE_CAPITAL", 7, "Интерпункција", "Голема буква", "Реченицата почнува со голема буква.", "Реченицата почнува со голема буква."),
    ("MK_PO_SEPARATED", 8, "Граматика", "Разделено по", "По се пишува слеано во компаратив: подобар, не по добар.", "По се пишува слеано со зборот што го степенува."),
    ("MK_SPACE_BEFORE_PUNCT", 9, "Интерпункција", "Белина пред интерпункција", "Нема белина пред запирка, точка и други знаци.", "Нема белина пред интерпункциски знак."),
    ("MK_ADJ_AGREEMENT", 10, "Граматика", "Род и број на придавката", "Придавката не се сложува со именката: убаво книга.", "Придавката мора да се сложува со именката во род и број."),
    ("MK_VERB_AGREEMENT", 11, "Граматика", "Лице и број на глаголот", "Глаголот не се сложува со подметот: тој сакаат.", "Глаголот мора да се сложува со подметот во лице и број."),
    ("MK_NUMERAL_GENDER", 12, "Граматика", "Два и две", "Два со машки, две со женски род: две книги, не два книги.", "Два се употребува со машки род, две со женски."),
    ("MK_COUNT_FORM", 13, "Граматика", "Бројна форма", "По број, бројната форма: пет града, не пет градови.", "По број, именките од машки род го земаат бројниот облик."),
    ("MK_OBJECT_DOUBLING", 14, "Граматика", "Удвојување на предметот", "Определениот предмет бара кратка заменка: ја видов книгата.", "Определениот директен предмет се удвојува со кратка заменка: ја видов книгата."),
]

# Tag to feature, in the order in which tags are looked at.
POS = {
    "n": "noun", "np": "proper", "adj": "adjective", "vblex": "verb", "vbser": "verb", "vbhaver": "verb", "vbmod": "verb", "vaux": "verb", "prn": "pronoun", "pr": "preposition",
    "cnjcoo": "conjunction", "cnjsub": "conjunction", "cnjadv": "conjunction", "num": "numeral", "adv": "adverb", "part": "particle", "det": "determiner", "ij": "interjection", "abbr": "abbreviation",
}
GENDER = {"m": "M", "mi": "M", "ma": "M", "f": "F", "nt": "N", "mfn": "C", "mf": "C"}
NUMBER = {"sg": "sg", "pl": "pl", "ct": "ct"}
DEFINITENESS = {"ind": "ind", "def": "def", "prx": "prx", "dst": "dst"}
