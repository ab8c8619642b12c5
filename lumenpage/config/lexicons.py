"""Word lists, patterns and weights that results depend on."""

# Stop words.
STOPWORDS = """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down
during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our
ours out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which
while who whom why will with would you your yours""".split()

# Abbreviations that end no sentence.
ABBREVIATIONS = ["Inc.", "Ltd.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "vs.", "e.g.", "i.e.", "etc.", "Co.", "Corp.", "St.", "No.", "approx."]

# Suffixes a stem loses, in the order they are tried.
SUFFIXES = ["ing", "ers", "er", "ies", "es", "s", "ed"]

# Public suffixes of two parts.
TWO_PART_SUFFIXES = ["co.nz", "org.nz", "net.nz", "govt.nz", "ac.nz", "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.in", "co.jp", "com.sg", "co.za", "com.br"]

# Words of a query that tell its purpose.
INTENT_WORDS = """best top vs versus compare comparison review reviews alternatives alternative recommended how what why when who which guide buy price pricing cost cheap near me free online list
ranking worth""".split()

# Cities and countries.
CITIES = [
    "auckland", "wellington", "christchurch", "hamilton", "dunedin", "tauranga", "queenstown", "sydney", "melbourne", "brisbane", "perth", "adelaide", "canberra",
    "london", "manchester", "new york", "san francisco", "los angeles", "chicago", "seattle", "austin", "boston", "toronto", "vancouver", "mumbai", "delhi", "bangalore",
    "kathmandu", "singapore", "tokyo", "berlin", "paris", "dublin", "amsterdam", "dubai", "hong kong", "shanghai", "beijing",
]
COUNTRIES = [
    "new zealand", "australia", "united states", "usa", "united kingdom", "uk", "canada", "india", "nepal", "china", "japan", "singapore", "germany", "france", "ireland",
    "south africa", "brazil", "mexico", "spain", "italy", "netherlands", "sweden", "norway", "denmark", "philippines", "malaysia", "indonesia", "thailand", "vietnam",
    "uae", "united arab emirates", "europe", "asia", "africa", "pacific", "fiji", "samoa", "tonga",
]

# Stock phrases.
FILLER_PHRASES = [
    "in today's fast-paced world", "in today's digital age", "it goes without saying", "needless to say", "at the end of the day", "game-changer", "game changer",
    "game-changing", "cutting-edge", "cutting edge", "state-of-the-art", "world-class", "best-in-class", "next-level", "take it to the next level", "unlock the power",
    "revolutionary", "seamless", "robust solution", "one-stop shop", "second to none", "look no further", "ever-evolving", "delve into", "in conclusion", "as we all know",
    "synergy", "holistic approach", "passionate about", "industry-leading", "innovative solutions", "tailored solutions", "unparalleled", "empower your", "supercharge", "elevate your",
]

# Cues of attribution, superlatives, recommendation, dependent openings and relationships.
ATTRIBUTION = [
    r"\baccording to\b", r"\bsources?:", r"\b(study|survey|report|research|analysis|whitepaper|white paper|audit)\s+(by|from|of|published)\b",
    r"\b(published|reported|found|estimated|stated|measured)\s+(by|in)\b", r"\[\d+\]", r"\(\s*(?:19|20)\d{2}\s*\)", r"\bdata from\b",
    r"\bas (?:reported|noted|stated|cited) (?:by|in)\b", r"\bcited\b",
]
SUPERLATIVES = [
    r"\bbest\b", r"\bleading\b", r"#1\b", r"\bnumber one\b", r"\bfastest\b", r"\bmost trusted\b", r"\btop[- ]rated\b", r"\baward[- ]winning\b", r"\bmarket leader\b", r"\bproven\b",
    r"\blargest\b", r"\bonly\b", r"\bguaranteed\b", r"\bmost popular\b", r"\bhighest[- ]rated\b",
]
RECOMMENDATION = [
    r"\bbest\b", r"\btop (?:pick|choice)\b", r"\brecommend(?:ed|s)?\b", r"\bideal\b", r"\bgreat (?:choice|option|fit)\b", r"\bleading\b", r"\bgo-to\b", r"\bstands? out\b",
    r"\bour pick\b", r"\bperfect for\b", r"\bexcellent\b", r"\bis a strong\b", r"\bpopular choice\b",
]
DEPENDENT_OPENER = r"^(?:this|that|these|those|it|they|he|she|however|moreover|additionally|also|furthermore|as mentioned|as noted|in addition|therefore|thus|such|similarly|likewise|meanwhile)\b"
QUESTION_START = r"^(what|how|why|when|where|who|which|can|does|do|is|are|should|will|could)\b"
REFERENCES_HEADING = r"\b(references|sources|citations|further reading|bibliography|footnotes)\b"
RELATIONSHIPS = {
    "partnership": r"partner(?:s|ed|ship)? (?:with|of)|in partnership with|teams? up with|collaborat\w+ with",
    "integration": r"integrat\w+ with|connects? (?:to|with)|works? with|compatible with|syncs? with",
    "competition": r"compet\w+ (?:with|against)|alternative to|versus|\bvs\.?\b|compared (?:to|with)|rival",
    "ownership": r"acquired by|acquired|owned by|subsidiary of|part of|parent company|merged with",
    "founding": r"founded by|co-founded by|created by|built by|developed by|launched by|started by",
    "location": r"based in|headquartered in|located in|offices? in|operates in|available in",
    "usage": r"used by|trusted by|customers include|clients include|serves|supplies|powers",
    "recognition": r"awarded by|certified by|accredited by|recogni[sz]ed by|featured in|listed on|reviewed by|ranked by",
}
INLINE_MARKER = r"\[\d+\]|\(source[^)]*\)|according to|\([a-z0-9-]+\.[a-z]{2,}\)"
LIST_LINE = r"^\s*(?:[-*•]|\d+[.)]|\*\*)"

# Organisation suffixes, titles of persons, words that are no names, acronyms that are none.
ORG_SUFFIXES = """inc ltd limited llc llp corp corporation co company group holdings pty gmbh plc technologies labs partners associates university institute foundation agency bank council
association society ministry department authority commission""".split()
PERSON_TITLES = "dr mr mrs ms prof professor ceo cto cfo coo founder co-founder director manager chair president head analyst".split()
NON_NAMES = """the this that these those there their they then than thus though however moreover also and but for with without from into our your its his her who what when where why how which while
whether some many most all any each every both either neither other another such here now if in on at by as of to it is are was were be been has have had do does did can could should would will may might
must we you he she one two three first second third next last more less best top key step note see read learn get start try use yes no not so or because after before during since until about above below over
under january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday overview introduction conclusion summary faq faqs pricing
features contact""".split()
NON_ACRONYMS = "A I OK US UK NZ AU EU FAQ FAQS PDF URL ID TV PM AM".split()

# Kinds of facts. The four of STRICT tell capitals apart.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
FACTS = {
    "percentage": r"\b\d+(?:\.\d+)?\s?%",
    "currency": r"(?i)(?:NZ\$|A\$|US\$|[$€£])\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:k|m|bn|million|billion))?|\b\d[\d,]*(?:\.\d+)?\s?(?:dollars|euros|pounds|NZD|USD|AUD)\b",
    "date": rf"\b{MONTH}\.?\s+(?:\d{{1,2}},?\s+)?(?:19|20)\d{{2}}\b|\b(?:19|20)\d{{2}}\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b",
    "measurement": r"(?i)\b\d[\d,]*(?:\.\d+)?\s?(?:GB|MB|TB|KB|GHz|MHz|kg|km|cm|mm|lbs?|oz|hrs?|hours|minutes|mins|days|weeks|months|years|users|customers|employees|countries|locations|integrations|seats|licen[cs]es|reviews|ratings|stars|x)\b",
    "quantity": r"(?i)\b\d{1,3}(?:,\d{3})+\b|\b\d+(?:\.\d+)?\s?(?:million|billion|thousand)\b",
    "definition": r"\b[A-Z][\w&'’\- ]{1,40}?\s(?:is|are|refers to|means|stands for)\s(?:a|an|the)\b",
    "comparison": r"(?i)\b(?:better than|faster than|cheaper than|more\s+\w+\s+than|less\s+\w+\s+than|compared (?:to|with)|versus|vs\.?)\b",
    "named_organisation": r"\b[A-Z][\w&'’\-]+(?:\s+[A-Z][\w&'’\-]+)*\s+(?:" + "|".join(sorted(s.capitalize() for s in ORG_SUFFIXES)) + r")\b",
}
CLAIM_FACTS = ["percentage", "currency", "quantity", "measurement"]

# Kinds of sources by their host, tried in order; a needle with a dot at an end matches the host padded with dots.
SOURCE_RULES = [
    ("encyclopaedia", ["wikipedia.org", "britannica.com", "wikidata.org"]),
    ("community_forum", ["reddit.com", "quora.com", "stackexchange.com", "stackoverflow.com", "news.ycombinator.com", "forum.", "community."]),
    ("social_video", ["linkedin.com", "facebook.com", "x.com", "twitter.com", "instagram.com", "youtube.com", "tiktok.com"]),
    ("review_directory", ["g2.com", "capterra.com", "trustpilot.com", "softwareadvice.com", "getapp.com", "yelp.com", "producthunt.com", "crunchbase.com", "tripadvisor.com", "glassdoor.com", "clutch.co", "sitejabber.com", "bbb.org", "review", "compar"]),
    ("academic_government", [".edu", ".gov", ".govt.", ".ac.", "arxiv.org", "nih.gov", "nature.com", "sciencedirect.com", "springer.com", "jstor.org"]),
    ("news_media", ["bbc.", "nytimes.com", "reuters.com", "theguardian.com", "forbes.com", "techcrunch.com", "nzherald.co.nz", "stuff.co.nz", "rnz.co.nz", "bloomberg.com", "cnn.com", "wsj.com", "theverge.com", "wired.com", "afr.com", "abc.net.au", "smh.com.au", "businessinsider.com", "cnbc.com", "ft.com", "news"]),
]

# Subtopics by intent: label and keywords.
FACETS = {
    "commercial": {
        "What it is (definition and overview)": ["is a", "is an", "refers to", "overview", "designed to"],
        "Key features and capabilities": ["feature", "includes", "offers", "functionality", "capability", "integration"],
        "Pricing and plans": ["price", "pricing", "cost", "plan", "per month", "free", "subscription", "trial", "$"],
        "Benefits and strengths": ["benefit", "advantage", "strength", "helps", "saves", "improves"],
        "Limitations and trade-offs": ["limitation", "drawback", "downside", "however", "not suitable", "lacks", "trade-off"],
        "Comparison with alternatives": ["alternative", "compared", "versus", "vs", "competitor", "instead of", "rather than"],
        "Use cases and target audience": ["for small", "suited", "ideal for", "use case", "designed for", "who it"],
        "Selection criteria": ["choose", "criteria", "consider", "factors", "what to look for", "decide"],
        "Evidence, reviews and proof": ["review", "rating", "rated", "tested", "study", "survey", "case study", "customers"],
        "Availability, support and setup": ["support", "available", "region", "country", "onboarding", "setup", "implementation"],
    },
    "transactional": {
        "Pricing and plans": ["price", "pricing", "cost", "plan", "per month", "free", "$"],
        "What is included": ["includes", "included", "features", "package"],
        "How to buy or sign up": ["buy", "sign up", "get started", "order", "book", "subscribe", "trial"],
        "Comparison with alternatives": ["alternative", "compared", "versus", "vs", "instead of"],
        "Guarantees, terms and support": ["guarantee", "refund", "terms", "support", "warranty", "cancel"],
        "Reviews and proof": ["review", "rating", "customers", "case study", "testimonial"],
    },
    "informational": {
        "Definition": ["is a", "is an", "refers to", "means", "defined as"],
        "How it works": ["how it works", "works by", "process", "mechanism", "steps"],
        "Components or types": ["types of", "components", "consists of", "categories", "kinds of"],
        "Benefits and applications": ["benefit", "used for", "application", "use case", "advantage"],
        "Examples": ["for example", "for instance", "example", "such as"],
        "Risks and limitations": ["risk", "limitation", "challenge", "drawback", "downside"],
        "Evidence and data": ["study", "research", "data", "survey", "statistics", "found that"],
        "Related concepts": ["related", "similar to", "differs from", "compared with", "alternative"],
    },
    "howto": {
        "Prerequisites": ["prerequisite", "before you", "you will need", "requirements"],
        "Step-by-step process": ["step", "first", "next", "then", "finally"],
        "Tools and resources": ["tool", "software", "template", "resource", "equipment"],
        "Common mistakes": ["mistake", "avoid", "pitfall", "common error"],
        "Time and cost": ["takes", "minutes", "hours", "cost", "budget"],
        "Examples": ["for example", "example", "sample"],
        "Troubleshooting": ["troubleshoot", "fix", "problem", "issue", "if it fails"],
    },
    "local": {
        "Location and service area": ["located", "address", "service area", "based in", "serves"],
        "Services offered": ["services", "we offer", "offers", "specialis"],
        "Opening hours and contact": ["hours", "open", "phone", "email", "contact"],
        "Pricing": ["price", "pricing", "cost", "from $", "quote"],
        "Reviews and credentials": ["review", "rating", "licensed", "certified", "accredited", "years of experience"],
    },
    "navigational": {
        "About the organisation": ["about", "founded", "mission", "team", "history"],
        "Products and services": ["product", "service", "solutions", "offers"],
        "Pricing": ["price", "pricing", "plan", "cost"],
        "Support and contact": ["support", "contact", "help", "phone", "email"],
    },
}
