"""Small tables for tests: a lexicon, readings and sentences with what the rules say of them."""

# Vocabulary and readings of the fixture (surface, lemma, tags).
LEXICON = (
    "тој таа тоа тие ми го ја им даде остави дошол дошла дошле водел водела убавата книгата книга и ѝ не сака пријател мој добар непријател нестане "
    "најдобар подобар утре постар па ск град дома рече обединувајќи ги сите точка стоеше сам продолжи итн поуспешно"
).split()

_N, _A = "n {} {} nom {}", "adj {} {} nom {}"
MORPH = [
    ("книга", "книга", _N.format("f", "sg", "ind")), ("книгата", "книга", _N.format("f", "sg", "def")), ("книги", "книга", _N.format("f", "pl", "ind")), ("книгите", "книга", _N.format("f", "pl", "def")),
    ("убава", "убав", _A.format("f", "sg", "ind")), ("убавата", "убав", _A.format("f", "sg", "def")), ("убавите", "убав", _A.format("mfn", "pl", "def")), ("убаво", "убав", _A.format("nt", "sg", "ind")),
    ("градот", "град", _N.format("m", "sg", "def")), ("град", "град", _N.format("m", "sg", "ind")), ("градови", "град", _N.format("m", "pl", "ind")), ("града", "град", _N.format("m", "pl", "ind")), ("града", "града", _N.format("f", "sg", "ind")),
    ("ми", "ми", "prn pers clt p1 mfn sg dat"), ("го", "clitic", "prn pers clt p3 m sg acc"), ("ја", "clitic", "prn pers clt p3 f sg acc"), ("им", "clitic", "prn pers clt p3 mfn pl dat"),
    ("ѝ", "clitic", "prn pers clt p3 f sg dat"), ("и", "clitic", "prn pers clt p3 f sg dat"), ("и", "и", "cnjcoo"), ("ти", "clitic", "prn pers clt p2 mfn sg dat"), ("ти", "free", "prn pers p2 mfn sg nom"),
    ("таа", "таа", "prn pers p3 f sg nom"), ("тој", "тој", "prn pers p3 m sg nom"), ("тоа", "тоа", "prn pers p3 nt sg nom"), ("тие", "free", "prn pers p3 mfn pl nom"), ("они", "они", "prn pers p3 mfn pl nom"), ("они", "они", "prn pers p2 mfn pl nom"),
    ("не", "не", "adv"), ("не", "clitic", "prn pers clt p1 mfn pl acc"), ("да", "да", "part"), ("мој", "мој", "det pos ind sg"),
    ("даде", "даде", "vblex perf tv aor p3 sg"), ("остави", "остави", "vblex perf tv aor p3 sg"), ("рече", "рече", "vblex perf tv aor p3 sg"), ("погоди", "погоди", "vblex perf tv aor p3 sg"),
    ("водел", "воде", "vblex impf lp m sg"), ("водела", "воде", "vblex impf lp f sg"), ("дошол", "дојде", "vblex perf lp m sg"), ("дошла", "дојде", "vblex perf lp f sg"), ("дошле", "дојде", "vblex perf lp mfn pl"),
    ("сака", "сака", "vblex impf tv pres p3 sg"), ("сакаат", "сака", "vblex impf tv pres p3 pl"), ("сакам", "сака", "vblex impf tv pres p1 sg"), ("сакајќи", "сака", "vblex impf tv pprs adv"), ("учат", "учи", "vblex impf tv pres p3 pl"),
    ("напишан", "напише", "vblex perf tv pp m sg ind"), ("прави", "прав", _A.format("mfn", "pl", "ind")), ("прави", "прави", "vblex impf tv imp sg"), ("објаснив", "објасни", "vblex perf tv aor p1 sg"), ("дадов", "даде", "vblex perf tv aor p1 sg"),
    ("видов", "вид", "n m sg nom prx"), ("видов", "види", "vblex perf tv aor p1 sg"), ("видам", "види", "vblex perf tv pres p1 sg"), ("спијам", "спие", "vblex impf iv pres p1 sg"),
    ("добар", "добар", _A.format("m", "sg", "ind")), ("најдобар", "добар", "pref sup " + _A.format("m", "sg", "ind")), ("подобар", "добар", "pref comp " + _A.format("m", "sg", "ind")), ("стар", "стар", _A.format("m", "sg", "ind")),
    ("успешно", "успешен", _A.format("nt", "sg", "ind")), ("успешно", "успешно", "adv"), ("секаков", "секаков", "adj m"), ("спроведениот", "спроведен", _A.format("m", "sg", "def")), ("уставно", "уставен", _A.format("nt", "sg", "ind")),
    ("железнички", "железнички", _A.format("mfn", "pl", "ind")), ("железнички", "железнички", _A.format("m", "sg", "ind")), ("пат", "пат", _N.format("m", "sg", "ind")), ("пријател", "пријател", _N.format("m", "sg", "ind")),
    ("професор", "професор", _N.format("m", "sg", "ind")), ("право", "право", _N.format("nt", "sg", "ind")), ("референдум", "референдум", _N.format("m", "sg", "ind")),
    ("два", "два", "num m nom ind"), ("два", "два", "num nt nom ind"), ("две", "два", "num f nom ind"), ("пет", "пет", "num mfn nom ind"), ("двајца", "два", "num ma nom ind"), ("втори", "втор", "num mfn pl nom ind"),
    ("ученици", "ученик", _N.format("m", "pl", "ind")), ("села", "село", _N.format("nt", "pl", "ind")), ("филмот", "филм", _N.format("m", "sg", "def")), ("децата", "дете", _N.format("nt", "pl", "def")),
    ("ноќта", "ноќ", _N.format("f", "sg", "def")), ("човекот", "човек", _N.format("m", "sg", "def")), ("писмото", "писмо", _N.format("nt", "sg", "def")),
]

#: (rule, text, first suggestion of each finding of that rule; None for a finding without one).
GRAMMAR = [
    ("MK_DOUBLE_DEFINITE", "убавата книгата", ["убавата книга"]), ("MK_DOUBLE_DEFINITE", "убавите книгите", [None]), ("MK_DOUBLE_DEFINITE", "убавата книга", []), ("MK_DOUBLE_DEFINITE", "убава книгата", []),
    ("MK_DOUBLE_DEFINITE", "убавата градот", []), ("MK_DOUBLE_DEFINITE", "убавата. книгата", []), ("MK_DOUBLE_DEFINITE", "убавата, книгата", []),
    ("MK_CLITIC_ORDER", "тој го ми даде", ["ми го даде"]), ("MK_CLITIC_ORDER", "тој ми го даде", []), ("MK_CLITIC_ORDER", "тој го ми", []), ("MK_CLITIC_ORDER", "не им остави", []),
    ("MK_DATIVE_I", "таа и го даде", ["ѝ"]), ("MK_DATIVE_I", "таа ѝ го даде", []), ("MK_DATIVE_I", "таа сака и го даде", []),
    ("MK_L_PARTICIPLE", "таа дошол", ["таа дошла"]), ("MK_L_PARTICIPLE", "тоа дошол", [None]), ("MK_L_PARTICIPLE", "таа дошла", []), ("MK_L_PARTICIPLE", "тие дошле", []), ("MK_L_PARTICIPLE", "го водела", []),
    ("MK_NE_FUSED", "тој несака", ["не сака"]), ("MK_NE_FUSED", "Несака", ["Не сака"]), ("MK_NE_FUSED", "непријател", []), ("MK_NE_FUSED", "нестане", []), ("MK_NE_FUSED", "несакајќи", []), ("MK_NE_FUSED", "ненапишан", []),
    ("MK_NE_FUSED", "неправи", []), ("MK_NE_FUSED", "необјаснив", []), ("MK_NE_FUSED", "непогоди", []),
    ("MK_NAJ_SEPARATED", "нај добар", ["најдобар"]), ("MK_NAJ_SEPARATED", "Нај добар", ["Најдобар"]), ("MK_NAJ_SEPARATED", "нај книга", []),
    ("MK_PO_SEPARATED", "Тој е по добар", ["подобар"]), ("MK_PO_SEPARATED", "по пат", []), ("MK_PO_SEPARATED", "по стар пат", []), ("MK_PO_SEPARATED", "професор по уставно право", []), ("MK_PO_SEPARATED", "По успешно спроведениот референдум", []),
    ("MK_PO_SEPARATED", "по железнички пат", []), ("MK_PO_SEPARATED", "по успешно", ["поуспешно"]),
    ("MK_SENTENCE_CAPITAL", "Тој дојде. утре ќе врне.", ["Утре"]), ("MK_SENTENCE_CAPITAL", "утре", ["Утре"]), ("MK_SENTENCE_CAPITAL", "т. утре", []), ("MK_SENTENCE_CAPITAL", "Тоа итн. утре", []), ("MK_SENTENCE_CAPITAL", "Град.ск", []),
    ("MK_SENTENCE_CAPITAL", "137. стоеше", []), ("MK_SENTENCE_CAPITAL", "Рече: „…продолжи", []), ("MK_SENTENCE_CAPITAL", "Рече: „...продолжи", []), ("MK_SENTENCE_CAPITAL", "Тој дојде.\nутре", ["Утре"]), ("MK_SENTENCE_CAPITAL", "! утре", ["Утре"]),
    ("MK_SENTENCE_CAPITAL", "Тој рече, утре", []), ("MK_SENTENCE_CAPITAL", "Дома? сите", ["Сите"]),
    ("MK_SPACE_BEFORE_PUNCT", "Тој дојде , а таа не.", [","]), ("MK_SPACE_BEFORE_PUNCT", "Тој дојде :-)", []), ("MK_SPACE_BEFORE_PUNCT", "Тој дојде : таа", [":"]), ("MK_SPACE_BEFORE_PUNCT", "12 .", ["."]), ("MK_SPACE_BEFORE_PUNCT", "Тој, таа.", []),
    ("MK_ADJ_AGREEMENT", "убаво книга", [None]), ("MK_ADJ_AGREEMENT", "убава книга", []), ("MK_ADJ_AGREEMENT", "добар град", []), ("MK_ADJ_AGREEMENT", "секаков книга", []), ("MK_ADJ_AGREEMENT", "Убаво книга", []), ("MK_ADJ_AGREEMENT", "убаво книга град", []),
    ("MK_ADJ_AGREEMENT", "железнички пат", []),
    ("MK_VERB_AGREEMENT", "тој сакаат", [None]), ("MK_VERB_AGREEMENT", "тој не сакаат", [None]), ("MK_VERB_AGREEMENT", "тој ја даде", []), ("MK_VERB_AGREEMENT", "тој не сака", []), ("MK_VERB_AGREEMENT", "Ти дадов писмото.", []),
    ("MK_VERB_AGREEMENT", "тој прави", []), ("MK_VERB_AGREEMENT", "они сака", []), ("MK_VERB_AGREEMENT", "тој ми го сакаат", [None]), ("MK_VERB_AGREEMENT", "тој ми го не сакаат", []), ("MK_VERB_AGREEMENT", "тие сакаат", []),
    ("MK_NUMERAL_GENDER", "два книги", ["две книги"]), ("MK_NUMERAL_GENDER", "Две градови", ["Два градови"]), ("MK_NUMERAL_GENDER", "две книги", []), ("MK_NUMERAL_GENDER", "два града", []), ("MK_NUMERAL_GENDER", "два села", []),
    ("MK_COUNT_FORM", "пет градови", ["пет града"]), ("MK_COUNT_FORM", "пет ученици", []), ("MK_COUNT_FORM", "втори градови", []), ("MK_COUNT_FORM", "двајца ученици", []), ("MK_COUNT_FORM", "Две градови", []),
    ("MK_OBJECT_DOUBLING", "Видов книгата.", ["Ја видов книгата"]), ("MK_OBJECT_DOUBLING", "Ја видов книгата.", []), ("MK_OBJECT_DOUBLING", "Не го видов филмот.", []), ("MK_OBJECT_DOUBLING", "Рече книгата.", []), ("MK_OBJECT_DOUBLING", "Спијам ноќта", []),
    ("MK_OBJECT_DOUBLING", "Сакам ноќта", []), ("MK_OBJECT_DOUBLING", "Видов книга", []), ("MK_OBJECT_DOUBLING", "Сакам децата да учат", []), ("MK_OBJECT_DOUBLING", "Видов, книгата", []), ("MK_OBJECT_DOUBLING", "Ти дадов писмото.", ["го дадов писмото"]),
    ("MK_OBJECT_DOUBLING", "сакам децата", ["ги сакам децата"]),
]
