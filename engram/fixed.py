"""Word lists, patterns and weights whose results must equal those of the engine that this one replaces."""

STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could of in to for with on at "
    "from by as into through and but or nor not so yet if then than that this it its i me my we our you your he him his she her they them their"
).split()

EMOTIONAL_WORDS = (
    "love hate amazing terrible wonderful awful excited angry happy sad scared thrilled devastated furious anxious grateful disappointed proud "
    "embarrassed jealous best worst incredible horrible fantastic miserable"
).split()

TEMPORAL_MARKERS = [
    "deadline", "due date", "expires?", "scheduled", "appointment", "meeting", r"on \w+day", r"at \d{1,2}:\d{2}", r"by \w+", "until", "before", "after",
    r"in \d+ (?:days?|weeks?|months?|years?)", "next week", "next month", "this weekend", "tomorrow", "yesterday",
]
OPINION_MARKERS = [
    "I think", "I believe", "I feel", "in my opinion", "I prefer", "I like", "I love", "I hate", "I want", "I need", "I wish", "personally", "my favorite",
    "probably", "seems like", "might be", "could be", "I guess", "thinks?", "believes?", "prefers?", "preferred", "likes?", "liked", "loves?", "loved", "hates?",
    "hated", "overrated", "underrated", "best", "worst", "favorite", "should", "shouldn't", "ought to", "better", "rather",
]
EXPERIENCE_MARKERS = [
    "I went", "I visited", "I saw", "I met", "I did", "I made", "I had", "I was", "we went", "we visited", "we had", "I've been", "I've done", "I used to",
    "I remember", "I once", "last time I", "when I was", "my experience",
]

ROUTE_OPINION = ["think", "believe", "feel", "prefer", "like", "love", "hate", "dislike", "enjoy", "opinion", "seems?", "probably", "maybe", "might", "could be", "i guess", "personally", "in my view", "i'd say"]
ROUTE_TEMPORAL = ["scheduled", "deadline", "appointment", "planned", "tomorrow", "next week", "next month", "upcoming", "due date", "starts?", "ends?", "will happen", "going to", "plan to"]
ROUTE_EPISODIC = ["went", "visited", "traveled", "attended", "met", "saw", "did", "happened", "occurred", "took place", "experienced"]

#: In order of priority.
SIGNALS = {
    "request": ["please", "could you", "would you", "can you", "help", "need", "want", "looking for", "searching", "find", "tell me", "show me", "remind me", "remember"],
    "social": ["friend", "family", "colleague", "partner", "boss", "team", "relationship", "together", "married", "dating", "met with", "call", "message", "email", "chat"],
    "temporal": [
        "when", "date", "time", "schedule", "deadline", "tomorrow", "yesterday", "last week", "next month", "ago", "soon", "later", "earlier", "january", "february", "march", "april", "may", "june",
        "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    ],
    "emotional": ["happy", "sad", "angry", "frustrated", "excited", "worried", "anxious", "love", "hate", "afraid", "grateful", "disappointed", "thrilled", "upset", "feeling", "emotion", "mood"],
    "opinion": ["think", "believe", "prefer", "opinion", "recommend", "suggest", "should", "better", "worse", "best", "worst", "favorite", "in my view", "personally", "i feel", "i guess"],
}

#: Kind and pattern of personal data, applied in this order.
PII = [
    ("api_key", r"(?i)\b(?:sk-|pk-|api[_-]?key[_-]?)[A-Za-z0-9_-]{20,}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("phone", r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"),
]

ACTIVITIES = {
    "docs": ["documentation", "readme", "wiki", "spec", "prd", "design doc", "changelog", "api doc"],
    "architecture": ["architecture", "diagram", "system design", "schema", "api design", "data model", "erd"],
    "code": ["implement", "function", "class", "module", "refactor", "code", "feature", "component"],
    "test": ["test", "pytest", "jest", "coverage", "assertion", "mock", "spec", "unit test"],
    "debug": ["bug", "fix", "error", "stack trace", "debug", "issue", "exception", "traceback"],
    "deploy": ["deploy", "docker", "ci/cd", "pipeline", "release", "production", "staging", "build"],
    "config": ["config", "env", "settings", "setup", "install", "dependency", "package", "requirements"],
}

#: Channel weights of a query, and the groups that cross-channel boosts count.
CHANNEL_WEIGHTS = {"semantic": 1.5, "bm25": 1.0, "entity_graph": 1.0, "temporal": 1.0, "spreading": 1.0, "hopfield": 0.8}
CHANNEL_GROUPS = {"semantic": "content", "bm25": "content", "entity_graph": "structure", "temporal": "temporal", "spreading": "associative", "hopfield": "associative"}
RRF_K, RRF_ABSENT = 15, 1000

#: (alpha, beta) that a signal adds to an agent's trust.
TRUST_WEIGHTS = {"store": (1.0, 0.0), "rejected": (0.0, 2.0), "recall": (0.5, 0.0), "contradiction": (0.0, 3.0), "deletion": (0.0, 1.5)}

#: A text with one of these speaks of a cause.
CAUSAL_CUES = ["because of", "as a result", "resulted in", "in order to", "so that", "caused by", "due to", "led to", "therefore", "consequently", "because"]

#: Terms of vague time and the days that they stand for, from the day of the text.
VAGUE_TERMS = {"yesterday": -1, "today": 0, "tomorrow": 1, "recently": -7, "a while ago": -30, "soon": 7, "the other day": -3, "last night": -1}
#: First month of a season.
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}

#: Kind and pattern of secrets in order, in our own form; the last group is what stays readable.
SECRETS = [
    ("ANTHROPIC", r"sk-ant-[A-Za-z0-9_-]{16,}([A-Za-z0-9_-]{4})"),
    ("OPENAI", r"sk-[A-Za-z0-9_-]{16,}([A-Za-z0-9_-]{4})"),
    ("GITHUB", r"ghp_[A-Za-z0-9]{26,}([A-Za-z0-9]{4})"),
    ("AWS", r"AKIA[A-Z0-9]{12}([A-Z0-9]{4})"),
    ("SLACK", r"xoxb-[A-Za-z0-9-]{6,}([A-Za-z0-9-]{4})"),
    ("JWT", r"ey[A-Za-z0-9_-]{10,}\.ey[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{1,}([A-Za-z0-9_-]{4})"),
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]+(-----)"),
]
SECRET_LENGTH, SECRET_ENTROPY = 32, 4.5

#: Words and phrases that class a query.
MULTI_HOP_PHRASES = [
    "and then", "after that", "because", "how did", "as a result", "led to", "connection between", "relationship between", "what happened when",
    "what was happening", "during the time", "at the same time", "how did it affect", "what changed after", "what did they do after",
    "what did they do before", "what was the result", "what was the outcome", "what was the reason", "why did they", "in response to",
    "as a consequence", "prior to", "following that", "subsequent to", "in the meantime", "at that point", "which led to", "which caused",
    "which resulted in",
]
#: With two names in a query these make it multi-hop.
CAUSAL_QUERY = (
    "before after when while because then during since until once affect cause change happen result influence impact lead meet start stop begin "
    "end move leave join visit return"
).split()
TEMPORAL_QUERY = (
    "when date time year month ago before after during last next recently earlier later since until while between january february march april "
    "may june july august september october november december"
).split()
AGGREGATION_QUERY = (
    "all list every everything various different many several multiple summarize overview activities events hobbies instruments types things "
    "places jobs skills interests pets"
).split()
AGGREGATION_PATTERNS = [
    r"what (?:\w+ )?(?:activities|events|hobbies|types|things|places|jobs)",
    r"what (?:\w+ )?has .+ (?:done|visited|attended|participated|played|practiced)",
    r"how many (?:\w+ )?(?:times|events|things|places)",
    r"what are .+(?:'s|s') (?:\w+ )?(?:hobbies|interests|activities|skills)",
]
#: Capitalised words that begin a sentence and name nothing.
SENTENCE_STARTERS = "What Where Who Which How When Does Did Can Could Would Should Are Is Was Were Has Have The Tell".split()
FACTUAL_BEGINNINGS = ["what ", "where ", "who ", "which ", "how "]
OPINION_QUERY = ["think", "feel", "opinion", "prefer", "favorite", "best", "worst", "believe", "like about", "dislike", "enjoy", "hate", "love"]
VAGUE_QUERY = ["something about", "i think", "maybe", "not sure", "vaguely remember", "partially recall", "sort of", "kind of", "i forgot", "what was that"]
#: Channel weights by class of query, in the order of CHANNEL_WEIGHTS.
PRESETS = {
    "temporal": [0.8, 1.5, 0.8, 2.0, 0.5, 0.5],
    "multi_hop": [1.0, 0.8, 2.5, 0.5, 2.0, 0.7],
    "aggregation": [1.2, 1.5, 1.0, 0.5, 0.8, 0.6],
    "opinion": [1.8, 0.6, 0.8, 0.3, 0.5, 0.5],
    "factual": [1.2, 1.4, 1.0, 0.6, 0.8, 0.8],
    "entity": [1.0, 1.2, 3.0, 0.5, 1.5, 0.9],
    "general": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    "vague": [0.8, 0.5, 0.6, 0.3, 1.5, 1.1],
}

#: Words that no topic consists of.
TOPIC_STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do "
    "does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its "
    "itself just let me more most my myself no nor not now of off on once only or other ought our ours ourselves out over own same she should so "
    "some such than that the their theirs them themselves then there these they this those through to too under until up use using very was we "
    "were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
