"""Word lists and patterns that results rest on, as they are."""

# Words that carry no claim.
STOPWORDS = """the a an is was were are of to in on for and or it he she they that this with at by from as his her their about said says have had
has be been you i we not no yes there here""".split()

# Months and their short forms.
MONTHS = """january february march april may june july august september october november december
jan feb mar apr jun jul aug sep sept oct nov dec""".split()

# Where an answer is split into clauses, letter case aside.
CLAUSES = r"(?i)\s*(?:,\s*(?:and|but|then|so|which|who|where|while)\b|\b(?:and then|but then|and also|and|but|then|whereas|while)\b|[;:])\s*"

# First words of questions.
QUESTION_WORDS = "what who when where why how which whose did does do is are was were can could will would has have had".split()

# First words of requests.
REQUEST_WORDS = "tell show find remind play read give look search check list summarise summarize explain describe repeat stop cancel open".split()

# Words without a subject.
EMPTY_WORDS = """a about am and anything are as at be been but can could did do does else for from go going good have hello hey hi how i if in
is it just know me my next no not now of ok okay on or should so some something that the then there they think this to up us was we well were
what when where which who why will with would yeah yes you your""".split()

# Words that a refusal may use of its own.
FRAMING = """nothing about anything covers covered mention mentioned said say says saying heard hear know known knows only here yet still but though
while else record anyone anybody nobody none never not no been was were is are am do does did doesn don didn haven hasn wasn weren isn aren can
cannot could would that this it you your i me my we the a an of to in on for and or from with at as by so if what which there their they them
anywhere far apart any some something thing things one other location place where when who whom whose why how time times date day today tomorrow
yesterday week colour color reason reasons answer question topic subject detail details information specific specifics plan plans discussed discuss
came come up talked talk told tell asked ask recall remember having have has had get got going go want need like just now then also either nor
because regarding concerning related nearby more less much many all both each every""".split()

# What is taken off the front of a topic, in turn, and off its end; off the front of a question; the most words of a topic, and
# how many of a question's stand in for one.
TOPIC_LEADS = (r"(the question of|what|where|when|who|why|how)", r"(is|was|are|were|did|do|does|i|you|your)")
TOPIC_END = r"(said|says|saying|told|is|was|were|are|do|did|does|location|place|time|date)"
QUESTION_LEADS = (r"(what|where|when|who|why|how|do|did|does|is|are|was|were)", r"(i|you|we|my|your)")
TOPIC_WORDS, SPARE_WORDS = 6, 5

# What is said when nothing answers. {topic} and {fact} are put in.
NOTHING_BUT = "Nothing about {topic} -- though you did mention {fact}."
NOTHING_IN = "Nothing about {topic} in what's been said."
NOTHING_HERE = "Nothing about {topic} has been said here."

# What in the detail of a refused call says that credit has run out, and in a judge's error that the machinery failed.
OUT_OF_CREDIT = ("credit", "billing", "prepayment", "quota exceeded", "exceeded your current quota", "plan and billing")
INFRASTRUCTURE = ("foundationmodels", "modelmanager", "sensitivecontent", "languagemodelerror", "bad json", "timed out", "unavailable", "the bridge", "inference")
# What a line ends with that didn't sound finished; the peak level in decibels below which a device delivers silence.
UNFINISHED = "—"
SILENT_DB = -70.0
