"""Word lists and rule tables. All are fixed values: results depend on them and on their order."""

#: Literal corrections, applied one after another wherever they occur.
OCR_BASE = (
    ('ueutral', 'neutral'),
    ('humau', 'human'),
    ('leeel', 'level'),
    ('eital', 'vital'),
    ('siguificaut', 'significant'),
    ('lougsword', 'longsword'),
    ('aud', 'and'),
    ('chaiumail', 'chainmail'),
    ('moruiugstar', 'morningstar'),
    ('spliut', 'splint'),
    ('halfliug', 'halfling'),
    ('guome', 'gnome'),
    ('eariable', 'variable'),
    ('eeil', 'evil'),
    ('cau', 'can'),
    ('followiug', 'following'),
    ('uumber', 'number'),
    ('uautical', 'nautical'),
    ('thespiau', 'thespian'),
    ('busiuess', 'business'),
    ('bullyiug', 'bullying'),
    ('swiudliug', 'swindling'),
    ('suboruiug', 'suborning'),
    ('illusiouist', 'illusionist'),
    ('protectiou', 'protection'),
    ('displacemeut', 'displacement'),
    ('batou', 'baton'),
    ('riug', 'ring'),
    ('streugth', 'strength'),
    ('coufers', 'confers'),
    ('turuiug', 'turning'),
    ('stuuuiug', 'stunning'),
    ('iute', 'into'),
    ('equipmeut', 'equipment'),
    ('clothiug', 'clothing'),
    ('eestmeuts', 'vestments'),
    ('1st', '1st'),
    ('2ud', '2nd'),
    ('3rd', '3rd'),
    ('4th', '4th'),
    ('5th', '5th'),
    ('6th', '6th'),
    ('7th', '7th'),
    ('8th', '8th'),
    ('9th', '9th'),
    ('ou', 'on'),
    ('wheu', 'when'),
    ('irate', 'irate'),
    ('pau', 'pan'),
    ('piu', 'pin'),
    ('heaey', 'heavy'),
    ('fryiug', 'frying'),
    ('rolliug', 'rolling'),
    ('auy', 'any'),
    ('haudy', 'handy'),
    ('weapou', 'weapon'),
    ('Aligumeut', 'Alignment'),
    ('Poiuts', 'Points'),
    ('Hit Poiuts', 'Hit Points'),
    ('EQ', 'Equipment'),
    ('PA', 'Prime Attributes'),
    ('SA', 'Significant Attributes'),
)

#: Patterns and replacements, applied one after another without regard to case.
OCR_ADDITIONAL = (
    ('\\bvarions\\b', 'various'),
    ('\\baronnd\\b', 'around'),
    ('\\babont\\b', 'about'),
    ('\\byon\\b', 'you'),
    ('\\bsonnding\\b', 'sounding'),
    ('\\benconraged\\b', 'encouraged'),
    ('\\bwonld\\b', 'would'),
    ('\\bfonr\\b', 'four'),
    ('\\bcansed\\b', 'caused'),
    ('\\bflonrishing\\b', 'flourishing'),
    ('\\bshonld\\b', 'should'),
    ('\\bbecanse\\b', 'because'),
    ('\\bruinons\\b', 'ruinous'),
    ("\\bconldn't\\b", "couldn't"),
    ('\\bwarehonse\\b', 'warehouse'),
    ('\\bhonses\\b', 'houses'),
    ('\\bstricture\\b', 'structure'),
    ('\\bprosperons\\b', 'prosperous'),
    ('\\bwithont\\b', 'without'),
    ('\\bflonr\\b', 'flour'),
    ('\\bbnt\\b', 'but'),
    ('\\babut\\b', 'about'),
    ('\\bwhol\\b', 'whole'),
    ('\\bEnconnters\\b', 'Encounters'),
    ('\\benconnters\\b', 'encounters'),
    ('\\bConncil\\b', 'Council'),
    ('\\bconncil\\b', 'council'),
    ('\\bConrts\\b', 'Courts'),
    ('\\bconrts\\b', 'courts'),
    ('\\bSonth\\b', 'South'),
    ('\\bsonth\\b', 'south'),
    ('\\bHonse\\b', 'House'),
    ('\\bhonse\\b', 'house'),
    ('\\bconrt\\b', 'court'),
    ('\\bcomcil\\b', 'council'),
    ('\\bconntry\\b', 'country'),
    ('\\bsonthern\\b', 'southern'),
    ('\\bnortb\\b', 'north'),
    ('\\bsoutb\\b', 'south'),
    ('\\bwesl\\b', 'west'),
    ('\\beasl\\b', 'east'),
    ('\\bsmilh\\b', 'smith'),
    ('\\bmodem\\b', 'modern'),
    ('\\bclem\\b', 'chem'),
    ('\\s+,\\s+', ', '),
    ('\\s+\\.\\s+', '. '),
    ('\\s+;\\s+', '; '),
    ('\\s+:\\s+', ': '),
    ('\\benconrage\\b', 'encourage'),
    ('\\brecnrring\\b', 'recurring'),
    ('\\boccnr\\b', 'occur'),
    ('\\baccnrate\\b', 'accurate'),
    ('\\bsecnre\\b', 'secure'),
    ('\\bfnture\\b', 'future'),
    ('\\bnatnre\\b', 'nature'),
    ('\\bpictnre\\b', 'picture'),
    ('\\bstrncture\\b', 'structure'),
    ('\\bfeatnres\\b', 'features'),
    ('\\bmeasnres\\b', 'measures'),
    ('\\btreasnres\\b', 'treasures'),
    ('\\bcreatnes\\b', 'creatures'),
    ('\\badventnres\\b', 'adventures'),
    ('\\bcnlture\\b', 'culture'),
    ('\\bcaptnre\\b', 'capture'),
    ('\\bmannfacture\\b', 'manufacture'),
)

#: Whole words that follow the patterns above.
OCR_OVERRIDES = (
    ('Enconnter', 'Encounter'),
    ('conrthouse', 'courthouse'),
    ('Connncil', 'Council'),
    ('Yggsburch', 'Yggsburgh'),
    ('moatbrldge', 'moatbridge'),
    ('neccessairly', 'necessarily'),
    ('necessairly', 'necessarily'),
    ('tendancy', 'tendency'),
    ('assocated', 'associated'),
    ('Ygesburgh', 'Yggsburgh'),
    ('Ygghsburgh', 'Yggsburgh'),
    ('Yggsbrugh', 'Yggsburgh'),
    ('Layont', 'Layout'),
    ('conrse', 'course'),
    ('surronnd', 'surround'),
    ('surronnding', 'surrounding'),
    ('throngh', 'through'),
    ('onnce', 'ounce'),
    ('previonsly', 'previously'),
    ('enongh', 'enough'),
    ('fonrth', 'fourth'),
    ('gatehonse', 'gatehouse'),
    ('gatehonses', 'gatehouses'),
    ('heonses', 'houses'),
    ('Marvel Playhonse', 'Marvel Playhouse'),
    ('Dark Chateu', 'Dark Chateau'),
    ('non-playe r', 'non-player'),
    ('esponsed', 'espoused'),
    ('monnds', 'mounds'),
    ('Wronght', 'Wrought'),
    ('north Citadel Park', 'North Citadel Park'),
    ('Rivergate', 'River Gate'),
    ('Moatgate', 'Moat Gate'),
)

#: Patterns and replacements of the last pass.
OCR_FINAL = (
    ('\\benconnters\\b', 'encounters'),
    ('\\bshonlder\\b', 'shoulder'),
    ('\\bmonstache\\b', 'moustache'),
    ('\\bthongh\\b', 'though'),
    ('\\bdonblet\\b', 'doublet'),
    ('\\balthongh\\b', 'although'),
    ('\\byonng\\b', 'young'),
    ('\\boeerbearing\\b', 'overbearing'),
    ('\\bchaiu\\b', 'chain'),
    ('\\biuto\\b', 'into'),
    ('\\bbardiug\\b', 'barding'),
    ('\\bnonr\\b', 'hour'),
    ('\\benconrage\\b', 'encourage'),
    ('\\benconraged\\b', 'encouraged'),
    ('\\benconraging\\b', 'encouraging'),
    ('\\bconnter\\b', 'counter'),
    ('\\baccnracy\\b', 'accuracy'),
    ('\\bmannfactured\\b', 'manufactured'),
    ('\\bpictnres\\b', 'pictures'),
    ('\\bstrnctures\\b', 'structures'),
    ('\\bnatnral\\b', 'natural'),
    ('\\bfnll\\b', 'full'),
    ('\\bstonld\\b', 'should'),
    ('\\bconld\\b', 'could'),
    ('\\bwonld\\b', 'would'),
    ('\\bhonse\\b', 'house'),
    ('\\bsonth\\b', 'south'),
    ('\\bnorth\\b', 'north'),
    ('\\bearth\\b', 'earth'),
    ('\\bsaltier\\b', 'saltire'),
    ('party per bend', 'parted per bend'),
    (' \\.', '.'),
    ('  +', ' '),
    ('”', '"'),
    ('“', '"'),
    ('’', "'"),
    ('‘', "'"),
    ('–', '-'),
    ('—', '-'),
    ('…', '...'),
    ('\\s+\\.\\s+', '. '),
    ('\\s+,\\s+', ', '),
    ('\\s+;\\s+', '; '),
    ('\\s+:\\s+', ': '),
    ('\\s+\\?\\s+', '? '),
    ('\\s+!\\s+', '! '),
    ('([a-zA-Z])\\.([A-Z])', '\\1. \\2'),
    ('([a-zA-Z]),([a-zA-Z])', '\\1, \\2'),
    ('\\s{3,}', '  '),
    ('\\s{2,}$', ''),
)

#: Whole words, in this case only.
TYPOS = (
    ('neccessairly', 'necessarily'),
    ('necessairly', 'necessarily'),
    ('tendancy', 'tendency'),
    ('assocated', 'associated'),
    ('Ygesburgh', 'Yggsburgh'),
    ('Ygghsburgh', 'Yggsburgh'),
    ('Yggsbrugh', 'Yggsburgh'),
    ('Yggsburghs', 'Yggsburgh’s'),
    ('Layont', 'Layout'),
    ('conrse', 'course'),
    ('surronnd', 'surround'),
    ('surronnding', 'surrounding'),
    ('throngh', 'through'),
    ('onnce', 'ounce'),
    ('previonsly', 'previously'),
    ('enongh', 'enough'),
    ('fonrth', 'fourth'),
    ('gatehonse', 'gatehouse'),
    ('gatehonses', 'gatehouses'),
    ('Marvel Playhonse', 'Marvel Playhouse'),
    ('Dark Chateu', 'Dark Chateau'),
    ('non-playe r', 'non-player'),
)

#: Literal corrections on heading lines.
HEADING_FIXES = (
    ('Backgronnd', 'Background'),
    ('Overveiw', 'Overview'),
    ('north Citadel Park', 'North Citadel Park'),
)

#: Letter pairs that English lacks.
RARE_PAIRS = """
bq cj cv dx fq fx gq gx hx jq jx kq kx mx px qb qc qd qf qg qh qj qk ql qm qn qp qr qs qt qv qw qx qy qz vf vj vq vx wx xj xq xv xz zj zq zx
""".split()

#: Known words that the patterns would flag. The other known words match no pattern, so listing them would change nothing.
KNOWN_WORDS = """
longsword shortsword morningstar yggsburgh zagyg wynchwood buckswood darktran yggs coldsprings northgate townbridge dex country question six box
beauty quick system
""".split()

END_CONJUNCTIONS = """
and or but yet so nor for
""".split()

END_PREPOSITIONS = """
of in at on by for with from to into onto upon about under over through during before after since until within without beneath beyond beside between
among against across around behind below above near toward towards
""".split()

END_ARTICLES = """
a an the
""".split()

END_DETERMINERS = """
this that these those some any each every all both either neither many much more most few little less least several various
""".split()

END_RELATIVE_PRONOUNS = """
that which who whom whose where when why how
""".split()

START_CONTINUATIONS = """
and or but yet so however therefore thus then also furthermore moreover nevertheless nonetheless meanwhile likewise similarly consequently accordingly
""".split()

ORPHANS = """
the a an and or but of in to for with on at by from that which who this these those
""".split()

RELATIVE_WORDS = """
who which that where when whose
""".split()

OBJECT_VERBS = """
wears has uses holds carries takes gives shows makes does says tells knows sees gets finds keeps brings puts calls
""".split()

INCOMPLETE_VERBS = """
will would can could should shall may might must does did has have had is are was were am be been being
""".split()

POSSESSIVES = """
his her its their my your our
""".split()

ACTION_VERBS = """
wear say go come take make give tell know think see get use find work call try ask need feel become leave put mean keep let begin seem help show hear
play run move live believe hold bring happen write provide sit stand lose pay meet include continue set learn change lead understand watch follow stop
create speak read allow add spend grow open walk win offer remember love consider appear buy wait serve die send expect build stay fall cut reach kill
remain
""".split()

#: Words after which a sentence goes on.
UNFINISHED_ENDINGS = """
a an the at by for from in of on to with above below after before beyond under over through into upon across around about against among between during
within without and but or so yet nor this that these those each every all some any many much more most few little less least several both either
neither is are was were be been being have has had will would could should might may must can do does did goes comes takes makes gives gets puts
stands sits runs walks looks seems appears becomes remains stays follows needs wants works lives holds means falls allows who whom whose which what
when where why how
""".split()

#: Words that go on with a sentence.
CONTINUING_STARTS_1 = """
however thus therefore nevertheless furthermore moreover likewise also then so and but or yet still besides additionally consequently hence
accordingly meanwhile otherwise nonetheless instead rather indeed certainly surely clearly obviously particularly especially specifically generally
typically usually normally actually really quite very extremely highly fairly somewhat perhaps maybe possibly probably likely apparently evidently
fortunately unfortunately surprisingly interestingly importantly significantly notably remarkably undoubtedly definitely absolutely completely
entirely totally fully partly partially mainly mostly largely primarily chiefly principally basically essentially fundamentally ultimately finally
eventually gradually suddenly immediately instantly quickly rapidly slowly carefully gently quietly loudly briefly shortly recently currently
presently nowadays previously formerly originally initially firstly secondly thirdly lastly similarly differently conversely alternatively
comparatively relatively approximately roughly exactly precisely presumably supposedly allegedly reportedly arguably admittedly honestly frankly
seriously literally virtually practically effectively
""".split()

CONTINUING_STARTS_2 = """
conscious aware minded oriented focused concerned interested engaged involved committed dedicated devoted intended designed meant supposed expected
required needed wanted desired sought planned arranged organized prepared ready willing able capable qualified suitable appropriate proper correct
right wrong false true real actual genuine authentic original natural normal regular standard typical usual common ordinary simple basic fundamental
essential important significant major minor main primary secondary central key crucial critical vital necessary optional additional extra special
particular specific general broad wide narrow limited restricted confined contained included excluded related connected linked associated attached
joined combined united separated divided split broken damaged destroyed ruined lost missing found discovered identified recognized known unknown
familiar unfamiliar strange odd unusual weird bizarre curious interesting fascinating amazing incredible remarkable extraordinary exceptional
outstanding excellent perfect ideal wonderful marvelous fantastic great good bad poor terrible awful horrible dreadful frightening scary dangerous
risky safe secure protected defended guarded watched observed noticed seen heard felt touched tasted smelled
""".split()

#: Words that resume a sentence after a blank line.
RESUMING_STARTS = """
was were is are had has have will would could should might may must can do does did and but or so yet nor for then thus also still however therefore
nevertheless better worse more less greater smaller higher lower stronger weaker faster slower than rather instead before after during while until
since because although though
""".split()

#: Words that leave a sentence open before a blank line.
MID_THOUGHT_ENDINGS = """
that which who where when how why being having decided thought felt knew member council committee group team
""".split()

#: Known headings of a book of names.
BOOK_HEADINGS = (
    'Outline',
    'Foreword',
    '1 Guide to names & naming',
    '2 People',
    '3 Epithets',
    '4 Places',
    '5 Fantastic names',
    'Appendices',
    'Bibliography',
    'Tables',
    'Table of contents',
    'Introduction',
    'Gamemasters',
    'Players',
    'How to use the book',
    'Scope, structure, & sundry',
    'Terminology',
    'Pronunciation',
    'Variants',
    'Authenticity',
    'Preparation and records',
    'A nominal history',
    "People's names",
    'Mixing names',
    'Place names',
    'Character names',
    'Campaign names',
    'Contemporary and historical',
    'Science fiction',
    'Fantasy',
    "What's all this, then?",
    'Mix and match',
    'Cultural crossover',
    'Anachronism',
    'But I need more',
    'More about names',
    'Religious names',
    'Forbidden names',
    'Historical and literary sources',
    'Honorifics',
    'Reputation',
    'Gamemastering names',
    'Apt names',
    'Expectations and English',
    'Rhythm and stress',
    'Male and female created he them',
    'Sound and meaning',
    'Aptitudes',
    'In brief',
    'Names and magic',
    'The power of names',
    'Divination by names',
    'Onomancy',
    'True names',
    'English',
    'Scottish',
    'Welsh',
    'Medieval English',
    'Gaelic',
    'Medieval French',
    'Celtic (Gaulish)',
    'Germanic',
    'Medieval Spanish',
)

DEMONSTRATIVES = "the a an this that these those".split()

#: Possible fixes that an error list looks for, in order (fixed values).
ERROR_FIXES = (
    ("saltier", "saltire"),
    ("party per bend", "parted per bend"),
    (" .", "."),
    ("  ", " "),
    ("”", '"'),
    ("“", '"'),
    ("’", "'"),
    ("‘", "'"),
)

#: Labels of name lists, and titles of a book of names by the level that they get (fixed values).
NAME_LABELS = ("Standard", "Other", "Common", "First common", "Second common")
TOP_TITLES = ("Appendices", "Bibliography", "Tables", "Foreword", "Outline")
LOW_TITLES = ("Terminology", "Pronunciation", "People's names", "A nominal history")
