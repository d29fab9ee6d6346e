"""Word lists, patterns and constants whose exact content decides results.

Patterns avoid look-around, ``\\b`` and possessive forms, so that the same text works in Java's and
in RE2's regular expressions.
"""

from __future__ import annotations

#: Verbs that open a strong line.
ACTION_VERBS = tuple(
    """led managed developed built designed implemented created launched drove increased reduced improved
    delivered established optimized architected scaled automated streamlined coordinated negotiated achieved
    spearheaded mentored transformed pioneered orchestrated accelerated consolidated eliminated enhanced executed
    facilitated generated integrated migrated overhauled redesigned refactored resolved revamped simplified
    supervised trained unified upgraded shipped owned secured deployed engineered rewrote authored analyzed
    conducted identified presented produced published planned won ran grew founded hired partnered defined cut
    ported rebuilt advised shaped standardized instrumented""".split()
)

#: A marker that opens a bullet; a number that does.
BULLET_MARKER = "^[\\s\u00a0]*[-*\u2022\u25cf\u2013\u25aa\u25e6\u2023\u25b6\u25ba\u00b7\ufffd]\\s+"
NUMBERED_BULLET = "^[\\s\u00a0]*[0-9]+[.)]\\s+"
BULLET_MIN_CHARS = 6
BULLET_MIN_WORDS, BULLET_MAX_WORDS = 8, 30
SPECIFICITY_TARGET = 0.6
MIN_BULLETS_TO_GRADE = 3

#: Each alone makes a line quantified.
STRONG_METRICS = (
    "[0-9]+([.][0-9]+)?%",
    "[$][0-9,.]+[KMBkmb]?",
    "[0-9]+([.][0-9]+)?[KMBkmb][+]?([^0-9A-Za-z_]|$)",
    "[0-9]+\\s*([x×])([^0-9A-Za-z_]|$)",
)
#: Years do not quantify.
YEAR = "(^|[^0-9A-Za-z_])(19|20)[0-9][0-9]($|[^0-9A-Za-z_])"
CARDINALS = "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|dozens?|hundreds?|thousands?|millions?|billions?"
CARDINAL_GAP = "[\\s\u2010-\u2015-]"
YEAR_TAIL = (
    "(twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)([\\s-](one|two|three|four|five|six|seven|eight|nine))?"
    "|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|one|two|three|four|five|six|seven|eight|nine"
)
NOT_COUNTING = "(^|[^0-9a-z_])(six\\s+sigma|big\\s+four)($|[^0-9a-z_])"

TIERS = ((80, "high", "Strong"), (60, "medium", "Getting There"), (0, "low", "Needs Work"))

#: Ladder of seniority labels, and the patterns that give a title its label (the first that matches).
SENIORITY_RUNGS = {"Intern": 0, "Junior": 1, "Mid": 2, "Senior": 3, "Lead": 4, "Staff": 5, "Principal": 6, "Manager": 6, "Director": 7, "VP": 8, "Executive": 9}
SENIORITY_PATTERNS = (
    ("Executive", "co-?founder|founder"),
    ("Executive", "chief\\s+.+\\s+officer"),
    ("Executive", "ceo|cto|cfo|coo|cio|cmo|ciso|cxo"),
    ("VP", "svp|senior\\s+vice\\s+president"),
    ("VP", "evp|executive\\s+vice\\s+president"),
    ("VP", "vp|vice\\s+president"),
    ("Director", "director|head\\s+of"),
    ("Manager", "manager"),
    ("Executive", "chief\\s+of\\s+staff"),
    ("Staff", "staff"),
    ("Principal", "principal"),
    ("Lead", "lead"),
    ("Senior", "senior|sr"),
    ("Junior", "junior|jr"),
    ("Intern", "intern(ship)?"),
)

#: Rating: weights of the axes, and the constants of their curves.
RATING_WEIGHTS = {"fitness": 0.45, "compensation": 0.35, "location": 0.1, "seniority": 0.1}
MAX_STARS, FIT_HALF, PAY_HALF, TERMS_HALF = 5.0, 9.0, 180000.0, 10.0
SENIORITY_STEP, OTHER_PLACE = 0.2, 0.5
HOURS_PER_YEAR, MONTHS_PER_YEAR, LEAST_ANNUAL_PAY = 2080, 12, 10000

#: Words at the end of a company name that do not tell companies apart.
LEGAL_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "company", "gmbh", "plc", "ag", "bv", "nv", "pty", "pvt", "pte", "oy", "ab")
REPOST_SPAN_DAYS = 21
SIMILAR_TITLE, OVERLAPPING_TEXT, TEXT_TOKEN_MIN = 0.6, 0.5, 3

#: Query parameters that do not change what a URL shows.
TRACKING_PARAMS = (
    "gclid", "fbclid", "msclkid", "yclid", "ttclid", "li_fat_id", "mc_cid", "mc_eid", "igshid", "_ga", "_gl", "gh_src",
    "lever-source", "lever-origin", "lever-via", "ref", "referer", "referrer", "refid", "trk", "trackingid", "src", "source",
)
TRACKING_PREFIX = "utm_"

QUERY_STOPWORDS = ("and", "or", "the", "of", "for", "with", "in", "at", "to", "on", "an", "a")

#: Evidence that a page is a posting: pattern and weight; four in all are enough.
POSTING_SIGNALS = (
    ("apply\\s*(now|for\\s*this)", 3),
    ("job\\s*(description|summary|details|overview)", 3),
    ("equal\\s*opportunity\\s*employer", 3),
    ("job\\s*(id|number|code|ref(erence)?)([^0-9a-z_]|$)", 3),
    ("responsibilities", 2),
    ("qualifications", 2),
    ("requirements?([^0-9a-z_]|$)", 2),
    ("certifications?\\s*(required)?", 2),
    ("about\\s*the\\s*(role|position|job)", 2),
    ("what\\s*you('ll| will)\\s*(do|bring)", 2),
    ("who\\s*you\\s*are", 2),
    ("/careers?/", 2),
    ("date\\s*published|posted\\s*(on|date)?", 1),
    ("work\\s*model|remote|hybrid|on.?site", 1),
    ("job\\s*category|employment\\s*type", 1),
    ("full.?time|part.?time|contract", 1),
    ("years?\\s*(of\\s*)?experience", 1),
    ("salary|compensation|pay\\s*range", 1),
    ("benefits|perks", 1),
    ("how\\s*to\\s*apply", 1),
    ("join\\s*our\\s*(team|talent)", 1),
)
SIGNAL_THRESHOLD = 4

#: A line with one of these opens a block of boilerplate.
BOILERPLATE_ANCHORS = (
    "equal opportunity employer", "equal employment opportunity", "without regard to race", "regardless of race",
    "we celebrate diversity", "we are an equal", "eeo statement", "eeo policy", "affirmative action",
    "reasonable accommodation", "ofccp", "pay transparency", "salary range", "compensation range", "base salary range",
    "expected base salary", "benefits we offer", "what we offer", "perks and benefits", "401(k)", "health insurance",
    "dental insurance", "vision insurance", "paid time off", "parental leave", "visa sponsorship", "sponsorship is not",
    "unable to sponsor", "must be authorized to work", "e-verify",
)

#: Sectors in order, each with the phrases that speak for it (regular expressions between word ends).
SECTORS = {
    "fintech": ("payments?", "ledger", "kyc", "trading", "banking", "fintech", "payment processing", "wire transfer", "underwriting", "fraud detection", "plaid", "stripe"),
    "devtools": ("ci/cd", "sdk", "developer experience", "compiler", "kubernetes", "devex", "cli", "build system", "linter", "ide", "developer tools?", "api platform"),
    "data-ml": ("machine learning", "pytorch", "etl", "spark", "llm", "data pipeline", "tensorflow", "mlops", "feature store", "data warehouse", "data science", "nlp"),
    "healthtech": ("healthcare", "clinical", "hipaa", "ehr", "emr", "patient", "telehealth", "pharma(ceutical)?", "medical device", "fhir"),
    "ecommerce": ("ecommerce", "e-commerce", "checkout", "shopping cart", "merchandising", "shopify", "fulfillment", "(online|retail|seller|consumer) marketplace", "marketplace (platform|operations)", "inventory management"),
    "gaming": ("game (engine|design|development)", "unity3d", "unreal engine", "gameplay", "multiplayer", "esports", "game studio"),
    "security": ("cybersecurity", "penetration testing", "threat detection", "soc 2", "vulnerability", "incident response", "zero trust", "iam", "siem"),
    "enterprise-saas": ("enterprise saas", "b2b saas", "crm", "erp", "workflow automation", "salesforce", "hrms", "sso"),
    "consumer-social": ("social media", "social network", "user engagement", "consumer app", "content feed", "creator economy", "dating app"),
    "hardware-iot": ("iot", "firmware", "embedded systems?", "robotics", "pcb", "sensors?", "wearables?", "hardware engineering"),
    "crypto-web3": ("blockchain", "web3", "crypto(currency)?", "smart contracts?", "solidity", "defi", "nft"),
    "edtech": ("edtech", "e-?learning", "curriculum", "lms", "online courses?", "student engagement"),
    "logistics-mobility": ("logistics", "supply chain", "fleet management", "ride-?sharing", "last mile", "freight", "warehouse (management|operations|automation)", "route optimization"),
    "media-adtech": ("adtech", "ad tech", "programmatic advertising", "publishing platform", "media platform", "(video|live|music) streaming", "streaming (platform|service)s?", "ad network", "content monetization"),
    "government-defense": ("government contract", "defense", "fedramp", "dod", "public sector", "clearance required", "civic tech", "military"),
}
CONFIDENT_HITS = 3

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PHONE = "([+]?[0-9]{1,3}[\\s.-]?)?[(]?[0-9]{3}[)]?[\\s.-]?[0-9]{3}[\\s.-]?[0-9]{4}"
FREE_MAIL = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "proton.me", "protonmail.com", "aol.com", "live.com", "me.com")
REMOTE_WORDS = ("remote", "worldwide", "anywhere", "wfh")
MONTHS = {m: f"{i:02d}" for i, names in enumerate(("jan january", "feb february", "mar march", "apr april", "may", "jun june", "jul july", "aug august", "sep sept september", "oct october", "nov november", "dec december"), 1) for m in names.split()}
SIZE_BUCKETS = ((100, "0-100kb"), (300, "100-300kb"), (600, "300-600kb"), (1000, "600-1000kb"))
TIER_BITS = ("t0_layout", "t1_openresume", "t1_5_regex", "t2_ner", "t3_ocr")
VERB_BRIEF, PHRASE_BRIEF, COMPANY_CAP = 12, 8, 8
ALIGN_THRESHOLD = 0.3

#: Months, seasons and the forms of a date; a range has one of three shapes: with a separator, without one, season and years.
STRICT_MONTH = "January|Jan|February|Feb|March|Mar|April|Apr|May|June|Jun|July|Jul|August|Aug|September|Sept|Sep|October|Oct|November|Nov|December|Dec"
LOOSE_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*"
SEASON = "(?:Spring|Summer|Fall|Autumn|Winter)"
OPEN_END = "Present|Current|Now|Ongoing"
MONTH_ANCHOR = f"(?:{STRICT_MONTH}|Month)[.]?\\s+(?:[0-9]{{4}}|'[0-9]{{2}}|20XX|XXXX|####|Year)"
DATE_ANCHOR = f"{MONTH_ANCHOR}|{SEASON}\\s+[0-9]{{4}}|[0-9]{{1,2}}[/-][0-9]{{4}}|20XX|[0-9]{{4}}"
EXPECTED_END = "(?:(?:Expected|Exp[.]?)\\s+)?"
DATE_RANGE = (
    f"(?i)(?:({DATE_ANCHOR})\\s*(?:\u2013|\u2014|-|to|through)\\s*{EXPECTED_END}({DATE_ANCHOR}|{OPEN_END}))"
    f"|(?:({MONTH_ANCHOR})\\s+{EXPECTED_END}({MONTH_ANCHOR}|{OPEN_END}))"
    f"|(?:({SEASON}\\s+[0-9]{{4}}),\\s*([0-9]{{4}}))"
)
LOOSE_MONTH_YEAR = f"\\b{LOOSE_MONTH}[.]?\\s+(?:[0-9]{{4}}|'[0-9]{{2}})\\b"
STRICT_MONTH_YEAR = f"\\b(?:{STRICT_MONTH})[.]?\\s+(?:[0-9]{{4}}|'[0-9]{{2}})\\b"
NUMERIC_MONTH_YEAR = "\\b(?:0?[1-9]|1[0-2])[/-][0-9]{4}\\b"
BARE_YEAR = "\\b(?:19|20)[0-9]{2}\\b"
#: What every range has somewhere: a cheap test before the costly pattern.
DATE_HINT = "(?i)[0-9#]|xxxx|year"
PLACEHOLDER_DATE = "(?i)^(?:month(?:\\s+year)?|year)$"
PLACEHOLDER_FIELD = "(?i)^\\s*(?:(?:Mon|Month)\\s+)?(?:Year|YYYY)(?:\\s*(?:[\u2013\u2014-]|to)\\s*(?:(?:Mon|Month)\\s+)?(?:Year|YYYY))?\\s*$"
DATE_FIELD = f"(?i)^\\s*(?:(?:{DATE_RANGE.removeprefix('(?i)')})|(?:{DATE_ANCHOR})|(?:{OPEN_END}))\\s*$"
REPORTED_SEPARATOR, TRIMMED_SEPARATORS = ",;:|\u00b7\u2013\u2014-", ",;:|\u2013\u2014-"
PROGRAM_NOTE = "(?i)^(?:GPA[:\\s]|Minor\\b|Major\\b|Concentration\\b|Relevant Coursework\\b|Coursework\\b)"
#: A sentence break inside of a line: a dot between words, a capital, and later a word of lower case.
SENTENCE_BREAK, PROSE_WORDS = "[a-z]{2}[.]\\s+[A-Z][^.]*\\s[a-z]", 8
DATE_WORDS = ("(?i)\\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[.]?", "(?i)\\b(?:spring|summer|fall|autumn|winter)\\b", "\\b[0-9]{4}\\b", "(?i)\\b(?:present|current|expected|graduation|graduated|anticipated)\\b", "[\\s,\u2013\u2014|/().:-]+")
#: What the fields of an editor complain about.
PLACEHOLDER_MESSAGE = "Looks like an unfilled template placeholder \u2014 replace it with a real date"
DATE_MESSAGE = "Doesn't look like a date (try \u201cJan 2020\u201d, \u201c2020\u201d, or \u201cPresent\u201d)"
EMAIL_MESSAGE, URL_MESSAGE = "Doesn't look like an email address", "Doesn't look like a URL"
EMAIL_FIELD = "(?i)^(?:\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+[.][A-Z]{2,}\\b)$"
URL_FIELD = "(?i)^(?:https?://)?(?:[0-9A-Za-z_-]+[.])+[a-z]{2,}(?:[/?#][^\\s]*)?$"
STUDENT_YEARS, CAREER_ENTRIES, CAREER_YEARS = 5, 3, 2

#: Shapes of lines: employers, titles, schools, headings, furniture of pages, links.
COMPANY_WORDS = "Inc[.]?|LLC|Ltd[.]?|Limited|Corp[.]?|Corporation|Company|Co[.]?|GmbH|S[.]A[.]?|Pty[.]?|plc|Group|Holdings|Technologies|Systems|Labs|Solutions"
TITLE_WORDS = (
    "Engineer|Engineering|Developer|Manager|Director|Lead|Consultant|Analyst|Specialist|Associate|Architect|Principal|Officer|Designer|Scientist|Researcher|Administrator|Founder|Co-?founder|President|VP|Vice President|Head|Chief|CTO|CEO|COO|CFO|CIO|PM|TPM|SRE|DevOps"
    "|Assistant|Intern|Internship|Trainee|Apprentice|Coordinator|Technician|Representative|Supervisor|Strategist|Advisor|Adviser|Counselor|Recruiter|Accountant|Auditor|Editor|Writer|Producer|Teacher|Instructor|Lecturer|Professor|Tutor|Agent|Clerk|Ambassador|Volunteer|Fellow"
)
SCHOOL_WORDS = "(?:University|College|Institute|School|Academy|Polytechnic)s?"
LEGAL_END = "(?i)\\b(?:Inc|Corp|Corporation|Ltd|LLC|L[.]L[.]C|GmbH|PLC|Co|SA|NA|LP|LLP|PC)[.]?$"
GRADE_CODE = "^[A-Z]{1,3}[0-9]{1,2}(?:/[A-Z]{1,3}[0-9]{1,2})*$"
CONNECTORS = "a an the and or of for to with at by in on from off across".split()
FURNITURE, LONE_CV = "(?i)(^|[^A-Za-z])(r[e\u00e9]sum[e\u00e9]|curriculum\\s+vitae)($|[^A-Za-z])", "(?i)(?:^|\\s)cv(?:$|\\s)"
HEADER_CHARS, HEADER_WORDS, CAPITAL_WORDS, HEADER_FONT = 40, 4, 6, 1.15
HEADER_BULLET, HEADER_DIRT = "^[-*\u2022\u25cf\u2013\u25aa\u25e6\u2023\u25b6\u25ba\u00b7]", "[0-9,:\u00b7|\u2014\u2013/]"
LINKEDIN_PROFILE = "(?i)(?:https?://)?(?:www[.])?linkedin[.]com/(?:in|pub)/[A-Z0-9_%-]+/?"
LINKEDIN_OTHER = "(?i)linkedin[.]com/(company|jobs|feed|school|learning|pulse|posts|groups|showcase|games|events|help|legal|search|signup|login|home)($|[^0-9A-Za-z_])"
WEBSITE_TLDS = "com org net io dev me co app ai xyz tech page site info blog design edu gov us uk ca in au de fr nl eu".split()
LONE_LETTERS = ("c", "r", "d")
SKILL_RANGE = "(?i)[0-9]{4}\\s*[-\u2013]\\s*([0-9]{4}|present)"
ACHIEVEMENT_TYPE_CHARS = 28
#: Search and rating: weights of title scores, bands of the phrases, words that don't say what a role does.
TITLE_WORD_POINTS, LEVEL_POINTS, LEAST_WORD = 10, 4, 3
FIT_BANDS = ((4, "Excellent fit"), (3, "Strong fit"), (2, "Partial fit"))
FLOOR_BANDS = ((4.5, "Pay well above your floor"), (3, "Pay above your floor"), (2.5, "Pay at your floor"))
PAY_BANDS = ((4, "Top pay"), (3.2, "Strong pay"))
LEVEL_MATCH, LEVEL_GAP = 4.5, 3
LEVEL_WORDS = "senior sr junior jr staff principal lead chief head vp vice president director manager and the of for with".split()
STEM_CHARS, STEM_REST = 4, 4
LINK_SKILLS, LINK_PLACE_CHARS = 6, 100
#: Rows of the contact card: key, label, whether it may be missing. Below the floor a value is not trusted.
CONTACT_ROWS = (
    ("full_name", "Name", False), ("headline", "Headline", True), ("email", "Email", False), ("phone", "Phone", False), ("linkedin_url", "Professional profile", False),
    ("github_url", "GitHub", True), ("portfolio_url", "Portfolio", True), ("website_url", "Website", True), ("location", "Location", False), ("work_authorization", "Work authorization", True),
)
CONTACT_FLOOR, ESCALATION_CONFIDENCE = 0.5, 0.85
DUPLICATE_RANKS = {"certain": 3, "probable": 2, "possible": 1, "title-only": 0}

#: What may stand before and after an alias of a skill, and the weights of a posting's terms.
ALIAS_EDGE = "[\\s,;:.()\\[\\]/'\"–—]"
SKILL_WEIGHT, NOUN_WEIGHT = 1.0, 0.5

#: Confidence of a parse: gates, weights of fields, penalties; bands of a score in words.
EXTRACTION_FLOOR, NAME_FLOOR, TWO_COLUMN_CAP, SCANNED_CHARS = 0.5, 0.5, 0.7, 80
FIELD_WEIGHTS = {"full_name": 2.0, "email": 2.0, "experience": 2.5, "education": 1.0, "skills": 1.0, "phone": 0.5, "location": 0.5, "linkedin_url": 0.5, "summary": 0.5}
SOFT_PENALTIES = {"dates": 0.1, "garbled": 0.12, "mail": 0.06, "career": 0.08}
SCORE_WEIGHTS = {"specificity": 0.4, "structure": 0.3, "completeness": 0.3}
BAND_OPENERS = {"high": "This is in solid shape", "medium": "This is close", "low": "This has clear gaps to close"}
SCANNED_ADVICE = "This reads as a scanned image, not selectable text — export a real text-based PDF before anything else."
NOTHING_TO_GRADE = "add a few quantified bullets under your roles so there's something to grade"
NEXT_STEPS = {"specificity": "add metrics like numbers, %, or $ to more bullets so each one shows measurable impact", "structure": "tighten each bullet to a single line that opens with an action verb"}
ROUND_OUT = "round out the remaining contact and section fields"
MAX_FAMILIES, RUNNER_UP_SHARE = 2, 2
LEAST_SKILLS, LEAST_FRONT, FRONT_SHARE, SUGGESTIONS = 5, 3, 0.3, 6
STATUS_ALIASES = {"saved": "interested", "scouted": "interested", "shared": "interested", "withdrawn": "rejected"}
REQUIREMENTS_HEADING = "(?i)(^|[^0-9a-z_])(requirements?|qualifications?|you'?ll have|what you bring|what we'?re looking for|must have|nice to have)($|[^0-9a-z_])"
CURRENCY_SIGNS = {"USD": "$", "GBP": "£", "EUR": "€"}
PAY_SUFFIXES = {"hour": "/hr", "month": "/mo"}
SIDEBAR_RATIO = 0.7

#: Boards, captures, phrases and layout.
BOARD_TTL_HOURS, CACHED_POSTINGS, DERIVED_TITLE_CHARS = 12, 300, 80
CLOSED_HOSTS = (
    ("linkedin", "(?i)(^|[.])linkedin[.]com($|[^0-9A-Za-z_])"), ("indeed", "(?i)(^|[.])indeed[.]com($|[^0-9A-Za-z_])"), ("glassdoor", "(?i)(^|[.])glassdoor[.](com|co[.][a-z]{2})($|[^0-9A-Za-z_])"),
    ("workday", "(?i)(^|[^0-9A-Za-z_])(myworkdayjobs|workday)[.]com($|[^0-9A-Za-z_])"), ("wellfound", "(?i)(^|[.])(wellfound[.]com|angel[.]co)($|[^0-9A-Za-z_])"),
)
PHRASE_STOPS = "the a an and or but of to for with by from in on at into across over under as is was are were be been being this that these those it its their our my via per".split()
#: Characters of a line that its first phrase is looked for in first.
PHRASE_START = 100
SPACE_SHARE = 0.4

#: Searches from records: limits and small words; hosts of profiles (pattern, network, kind).
MOST_TITLES, MOST_SKILLS = 4, 12
SKILL_STOPS = "a an and at for in of on or the to with".split()
PROFILE_HOSTS = (
    ("(^|[.])linkedin[.]com$", "LinkedIn", "social"), ("(^|[.])github[.]com$", "GitHub", "code"), ("(^|[.])gitlab[.]com$", "GitLab", "code"), ("(^|[.])codeberg[.]org$", "Codeberg", "code"), ("(^|[.])kaggle[.]com$", "Kaggle", "code"),
    ("(^|[.])huggingface[.]co$", "Hugging Face", "code"), ("(^|[.])behance[.]net$", "Behance", "portfolio"), ("(^|[.])dribbble[.]com$", "Dribbble", "portfolio"), ("(^|[.])orcid[.]org$", "ORCID", "academic"),
    ("(^|[.])scholar[.]google[.]", "Google Scholar", "academic"), ("(^|[.])substack[.]com$", "Substack", "writing"), ("(^|[.])medium[.]com$", "Medium", "writing"),
)

#: Entries of a section: bullets that open a line, lines that are a place alone, words that open a paragraph, ends that run on, running heads.
LINE_BULLET = "^\\s*[•‣▪●◦⁃*\\-–—]"
OPEN_WORD = "(?i)\\b(?:Present|Current|Now|Ongoing)\\b"
PLACE_LINE = "^[A-Z][A-Za-z.\\-]+(?:\\s+[A-Z][A-Za-z.\\-]+)?,\\s*[A-Z]{2}$"
PARAGRAPH_VERB = (
    "(?i)^(?:Built|Designed|Implemented|Developed|Led|Architected|Optimi[sz]ed|Refactored|Deployed|Prototyped|Migrated|Automated|Delivered|Created"
    "|Engineered|Shipped|Wrote|Authored|Reduced|Improved|Increased|Launched|Ran)\\b"
)
DANGLING_END = "(?i)\\b(and|or|with|the|to|of|for|a|an|in|on|at|by|as|&)\\s*$"
RUNNING_WORD = "(?:r[ée]sum[ée]|resume|cv|curriculum\\s+vitae)"
RUNNING_HEAD = f"(?i){RUNNING_WORD}\\s*[·•‣|]|[·•‣|]\\s*{RUNNING_WORD}|{RUNNING_WORD}\\s+[0-9]"
PARAGRAPH_CHARS, PARAGRAPH_GAP, MARGIN, COLUMN_SPREAD = 60, 1.4, 2, 150

#: Sections by name: aliases, the last words that name one, whether split letters may be put together, whether a last word is enough.
SECTION_NAMES = {
    "summary": (("summary", "profile", "objective", "about", "about me", "professional summary"), ("summary", "profile", "objective"), True, True),
    "experience": (
        ("experience", "work experience", "professional experience", "employment", "employment history", "work history", "career", "career history", "volunteer experience", "community service", "leadership", "involvement",
         "on campus involvement", "campus involvement", "extracurricular", "extracurricular activities", "activities", "volunteer", "volunteering"),
        ("experience", "employment"), True, True,
    ),
    "education": (("education", "academic background", "academics", "qualifications", "coursework", "relevant coursework"), ("education", "academics", "qualifications", "coursework"), True, True),
    "skills": (
        ("skills", "top skills", "technical skills", "core competencies", "competencies", "expertise", "technologies", "programs, skills, software", "programs, skills & software"),
        ("skills", "competencies", "technologies", "expertise"), False, False,
    ),
    "projects": (("projects", "personal projects", "selected projects"), ("projects",), True, True),
    "certifications": (("certifications", "certificates", "licenses"), ("certifications", "certificates", "licenses"), True, True),
    "achievements": (
        ("achievements", "accomplishments", "awards", "awards & honors", "awards and honors", "honors", "honors & awards", "honors and awards"),
        ("achievements", "accomplishments", "awards", "honors"), False, True,
    ),
    "other": (("strengths", "highlights", "focus areas", "interests", "languages", "references", "hobbies", "publications"), (), False, False),
}
EXPERIENCE_QUALIFIERS = ("relevant", "additional", "performance", "involvement", "other", "related", "leadership", "extracurricular", "selected", "further")
SECTION_CHARS, SECTION_WORDS, HEADER_GAP = 40, 4, 1.4
DEFAULT_FONT, DEFAULT_LINE_HEIGHT = 10.0, 14.0
NAMED_SCHOOL = "(?i)\\b(University|College|Institute|Academy|Polytechnic)s?\\b"
STRONG_DATE = (
    f"(?i)\\b{LOOSE_MONTH}[.]?\\s+(?:[0-9]{{4}}|'[0-9]{{2}}|20XX)|\\b{SEASON}\\s+[0-9]{{4}}|[0-9]{{1,2}}[/-][0-9]{{4}}|\\b(?:Present|Current|Ongoing|Now)\\b|'[0-9]{{2}}\\b|\\b20XX\\b"
)
DEGREE = (
    "\\b(B[.]?A[.]?|B[.]?Sc[.]?|B[.]?S[.]?|B[.]?Eng[.]?|B[.]?E[.]?|B[.]?Tech[.]?|M[.]?A[.]?|M[.]?Sc[.]?|M[.]?S[.]?|M[.]?Eng[.]?|M[.]?B[.]?A[.]?|Ph[.]?D[.]?|M[.]?D[.]?|J[.]?D[.]?"
    "|Bachelor|Master|Doctor|Associate)(?:\\s+of\\s+[A-Za-z ]{2,40})?"
)
HEADERLESS_HOSTS, HEADERLESS_ROLES = ("profile", "summary", "other"), 2

#: Columns of pages: strips of a projection, the share of rows that may cross a gutter, the band that it lies in, and the least of each; gaps that part cells.
STRIP, GUTTER_COVERAGE, GUTTER_BAND, GUTTER_WIDTH, COLUMN_ROWS, COLUMN_ITEMS, PAGE_WIDTH = 3, 0.04, (0.2, 0.8), 0.01, 4, 30, 612.0
ROW_GAP, COLUMN_GAP, GRID_ROWS = 3.5, 50, 2

#: Pages of postings: what is never part of one, captions of other blocks, links of postings, hosts of application systems.
NON_POSTING_TAGS = ("nav", "aside", "footer", "form", "script", "style", "noscript")
NON_POSTING_CAPTIONS = (
    "people\\s+you\\s+can\\s+reach\\s+out\\s+to", "meet\\s+the\\s+(hiring\\s+team|team\\s+behind)", "\\b(similar|related|recommended|suggested|more)\\s+jobs\\b", "\\bjobs\\s+(you\\s+may|that\\s+may)\\b",
    "people\\s+also\\s+viewed", "trending\\s+employee\\s+content",
)
POSTING_LINKS = ("/jobs?/view/[0-9]", "[?&]currentJobId=[0-9]")
RAIL_ITEMS, CARD_TEXT = 2, 120
JOB_ID_METAS = ("JobIdentifier", "job-id", "jobId", "requisitionId", "job_id")
ATS_HOSTS = (
    ("greenhouse.io", "Greenhouse"), ("lever.co", "Lever"), ("taleo.net", "Taleo"), ("myworkdayjobs.com", "Workday"), ("icims.com", "iCIMS"), ("smartrecruiters.com", "SmartRecruiters"), ("jobvite.com", "Jobvite"),
    ("applytojob.com", "JazzHR"), ("breezy.hr", "Breezy HR"), ("ashbyhq.com", "Ashby"), ("bamboohr.com", "BambooHR"), ("recruitee.com", "Recruitee"), ("successfactors.com", "SAP SuccessFactors"), ("phenom.com", "Phenom"),
    ("oraclecloud.com", "Oracle HCM"), ("workable.com", "Workable"),
)
PREVIEW_CHARS = 200

#: Names and headlines at the top of a document; sizes that stand for the levels of markdown headings.
NAME_BOILERPLATE = ("resume", "résumé", "cv", "curriculum", "vitae", "sample", "template", "example", "draft", "chronological", "functional", "combination", "profile", "biography")
NAME_WORD, NAME_LINES, NAME_CHARS, NAME_WORDS, NAME_LETTERS = "^[A-Z][a-zA-Z.\\-']*$", 5, 60, 5, 0.7
NAME_POINTS = {"first": 0.4, "largest": 0.3, "large": 0.1, "cased": 0.2, "words": 0.1, "near_first": 0.15, "near_later": 0.4, "title": -0.6, "mononym": -0.1}
CONTACT_NEAR, HEADLINE_CHARS, HEADLINE_CONFIDENCE = 80, 60, 0.7
MARKDOWN_SIZES = {"h1": 16.0, "h2": 14.0, "h3": 12.0, "bold": 12.0, "body": 10.0}
LEADING_SECTION_CHARS = 60

#: Places that stand alone: states by code, cities, countries.
STATE_CODES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR GU VI AS MP".split()
CITIES = (
    "remote|hybrid|on-?site|New York City|New York|New Orleans|San Francisco|San Diego|San Jose|San Antonio|Los Angeles|Las Vegas|Salt Lake City|Mountain View|Palo Alto|Menlo Park|Santa Clara|Redwood City|Ann Arbor"
    "|washington|washington d[.]?c[.]?|boston|chicago|seattle|austin|denver|portland|atlanta|dallas|houston|phoenix|miami|detroit|philadelphia|pittsburgh|minneapolis|nashville|charlotte|columbus|indianapolis|baltimore"
    "|sacramento|raleigh|london|paris|berlin|munich|tokyo|singapore|bangalore|bengaluru|mumbai|delhi|hyderabad|toronto|vancouver|sydney|melbourne|dublin|amsterdam"
)
COUNTRIES = (
    "uk", "usa", "us", "uae", "south korea", "north korea", "s.korea", "s. korea", "n.korea", "n. korea", "india", "germany", "france", "united kingdom", "canada", "australia", "japan", "china", "brazil", "mexico", "singapore", "netherlands",
    "sweden", "norway", "denmark", "finland", "switzerland", "austria", "spain", "italy", "portugal", "poland", "ireland", "belgium", "new zealand", "south africa", "nigeria", "kenya", "egypt", "israel", "pakistan", "bangladesh", "indonesia",
    "malaysia", "thailand", "philippines", "vietnam", "argentina", "chile", "colombia", "ghana", "saudi arabia", "hong kong", "taiwan", "ukraine", "russia", "turkey", "greece", "czech republic", "hungary", "romania", "croatia", "serbia", "slovakia",
)
PLACE_WORDS = "[A-Z][A-Za-z.\\-]+(?:\\s+[A-Z][A-Za-z.\\-]+){0,2}"
#: Terms of postings: words that a gerund takes as an object, the longest alias that a slash may make another word's part.
OBJECT_OPENERS, SHORT_ALIAS = ("a", "an", "the", "some", "our", "its", "their", "his", "her", "this", "these", "those", "several", "many", "multiple"), 2
HEADING_TAILS = ("qualifications", "responsibilities", "requirements", "demands", "duties")
FUNCTION_WORDS = "the an as at in on of for to by with from and or but if this these those we you your our it is are".split()

#: Credentials: the type behind a degree's "of", what ends a field of study, grades, classes and honours.
DEGREE_TYPE = (
    "(?i)^(?:Business Administration|Fine Arts|Computer Applications|Science|Arts|Technology|Engineering|Philosophy|Education|Commerce|Laws|Law|Medicine|Architecture|Design|Nursing|Pharmacy|Business|Management)\\b"
)
FIELD_DATE = (
    "(?i)\\s*[-–—,;]?\\s*(?:(?:expected|anticipated|graduat\\w*|class of|present|current)\\b\\s*)*(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)[a-z]*[.]?\\s*)?[(]?(?:(?:19|20)[0-9]{2}|20XX)\\b.*$"
)
GRADE_NUMBER = "[0-9]{1,3}(?:[.][0-9]+)?(?![0-9])"
GRADE_VALUE = f"{GRADE_NUMBER}(?:\\s*/\\s*{GRADE_NUMBER})?(?:\\s*%)?"
GRADE_LABEL = "[cs]?gpa"
GRADE_FIRST = f"(?:(?:cumulative|cum[.]?|overall|major|final|current)\\s*)?\\b{GRADE_LABEL}\\b\\s*[:\\-–—]?\\s*({GRADE_VALUE})"
GRADE_LAST = f"({GRADE_VALUE})\\s*\\b{GRADE_LABEL}\\b"
GRADE_CLASS = (
    "(?i)^(?:(?:first|second|third)[\\s-]class(?:\\s+(?:honou?rs|with\\s+(?:distinction|merit)|upper\\s+division|lower\\s+division))?|(?:first|second|third)\\s+division|2:[12])$"
)
HONORS_LABEL = "(?i)^(?:latin\\s+)?honou?rs?\\s*[:\\-–—]\\s*"
HONORS = "(?i)^(?:(?:summa|magna)\\s+)?cum\\s+laude$|^(?:graduated\\s+)?with\\s+(?:high(?:est)?\\s+)?(?:honou?rs|distinction)$"
STUDY_PARTS = "\\s*[,;·•|]\\s*|\\s+[-–—]\\s+"
STUDY_NOTE = f"(?i)^(?:minor|major|{GRADE_LABEL}|concentration)\\b"
PROJECT_POINTS = {"name": 0.4, "date": 0.2, "bullet": 0.4}

#: The right to work: nations, clauses, classes of visas, words of a status, and the forms that say one.
NATION = (
    "u[.]?s[.]?a[.]?|u[.]?s[.]?|united states(?: of america)?|american|u[.]?k[.]?|united kingdom|great britain|britain|british|england|scotland|wales|northern ireland|irish|ireland|e[.]?u[.]?|european union|eea|schengen(?: area)?"
    "|canadian|canada|australian|australia|new zealand|indian|india|singapore|german|germany|french|france|spanish|spain|italian|italy|dutch|netherlands|swiss|switzerland|swedish|sweden|polish|poland|mexican|mexico"
    "|brazilian|brazil|japanese|japan|south african|south africa|u[.]?a[.]?e[.]?|united arab emirates|israeli|israel|nigerian|nigeria|filipino|philippines"
)
NATIONS = f"(?:{NATION})(?:(?: ?[/&+] ?| and | or )(?:the )?(?:{NATION}))*"
WORK_CLAUSE = (
    f"(?: (?:in|within) (?:the |any )?{NATIONS}| (?:for|with) any (?:employer|company)| (?:without|with no)(?: any| current| future| current or future)?(?: visa| employer| work| employment)? sponsorship"
    "(?: (?:required|needed|now or in the future))?| (?:without|with no)(?: any)? restrictions?)"
)
VISA_CLASS = (
    "h-? ?1-? ?b1?|h-? ?4|l-? ?1[ab]?|l-? ?2|o-? ?1|e-? ?2|e-? ?3|tn-? ?1?|j-? ?1|f-? ?1|b-? ?1|(?:stem )?opt|cpt|ead|green ?card|blue card|tier 2|skilled worker(?: visa)?|indefinite leave to remain|ilr|(?:pre-)?settled status"
    "|work permit|work visa|student visa|spouse visa"
)
STATUS_WORD = (
    "unrestricted|unlimited|indefinite|authori[sz]ed|eligible|valid|active|yes|citizenship|citizen|national|(?:lawful |legal )?permanent resident|naturali[sz]ed(?: citizen)?|dual|none required|none|not required"
    "|no sponsorship required|sponsorship not required|no restrictions?"
)
STATUS_LABEL = (
    "citizenship|visa status|visa type|work permit|work (?:authori[sz]ation|eligibility)(?: status)?|employment (?:authori[sz]ation|eligibility)(?: status)?|immigration status|residency status"
)
STATUS_TOKEN = f"(?:{VISA_CLASS}|{STATUS_WORD}|{NATION})"
STATUS_PATTERNS = (
    f"^(?:dual citizen(?:ship)?|(?:(?:dual|naturali[sz]ed) )?{NATIONS} citizen(?:ship)?)$",
    f"^(?:{NATIONS} )?green ?card(?: holder)?$",
    f"^(?:{NATIONS} )?(?:lawful |legal )?permanent resident(?: card)?(?: holder)?$",
    f"^(?:legally |fully |currently )?(?:authori[sz]ed|eligible|entitled|permitted) to work{WORK_CLAUSE}{{1,3}}$",
    f"^(?:work|employment) authori[sz]ed{WORK_CLAUSE}{{0,3}}$",
    f"^(?:full |unrestricted |permanent )?right to work{WORK_CLAUSE}{{1,3}}$",
    f"^(?:{STATUS_LABEL})\\s*[:–—-]\\s*(?:{STATUS_TOKEN}(?:[ /,+&-]+{STATUS_TOKEN}){{0,3}})$",
    "^(?:(?:will |does |do )?not (?:require|seeking|need)|requires? no|no)(?: any| current| future| ongoing)?(?: visa| employer| work| employment)? sponsorship(?: (?:is )?(?:required|needed|necessary))?(?: now or in the future)?$",
    "^(?:visa |work |employment )?sponsorship (?:is )?not (?:required|needed|necessary)(?: now or in the future)?$",
    f"^{NATIONS} passport holder$",
)
STATUS_HINT = "(?i)citizen|green ?card|permanent resident|to work|sponsor|passport holder|visa|permit|immigration|residenc|authori[sz]|eligib|national"

#: Pay: currencies, figures, separators, periods, magnitudes that are no pay, words of pay and how near they must be.
PAY_SIGNS = {"$": "USD", "£": "GBP", "€": "EUR"}
PAY_MARK = "(?:([$£€])|\\b(USD|EUR|GBP|CAD|AUD|NZD|CHF)\\b)"
PAY_FIGURE = "([0-9]+(?:,[0-9]{3})+(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?)\\s*(?:([kK])(?![a-zA-Z]))?"
PAY_JOINT = "(-|–|—|~|\\bto\\b|\\band\\b)"
PAY_PERIOD = "(?:\\s*(?:/|per\\s+)\\s*(hour|hr|year|yr|annum|month|mo)\\b)?(?:\\s*\\b(annually|hourly|monthly|yearly)\\b)?"
PAY_RANGE = f"(?i){PAY_MARK}\\s*{PAY_FIGURE}\\s*{PAY_JOINT}\\s*(?:{PAY_MARK}\\s*)?{PAY_FIGURE}{PAY_PERIOD}"
PAY_SINGLE = f"(?i){PAY_MARK}\\s*{PAY_FIGURE}{PAY_PERIOD}"
PAY_MAGNITUDE = "(?i)^\\s*(?:million|billion|mm|bn|m|b)\\b"
PAY_WORD = "(?i)\\b(?:salary|salaries|compensation|comp|pay|base|ote|wage|wages|earn|earnings|remuneration|stipend|annual|annually)\\b"
PAY_INTRO, PAY_WINDOW, SENTENCE_MARKS = "(?i)\\b(?:between|from|range\\s+of)\\s*$", 60, "[.;!?\\n]"
PERIODS = {"hour": "hour", "hr": "hour", "hourly": "hour", "month": "month", "mo": "month", "monthly": "month"}
NOT_FILLED = ("id", "created_at", "updated_at", "deleted_at", "notes", "alias_urls", "capture", "origin")

#: Judging a search: the family of leading roles, how many terms are named, how many skills of the other side speak against the titles.
LEADERSHIP, MISSING_TITLES, MISSING_SKILLS, NAMED_TITLES, OFF_AXIS_SKILLS, RESOLVED_PROFILES = "leadership", 3, 5, 3, 4, 5

#: Lines of rewritings: what a metric counts, how a model announces its answer, marks that open a list; marker characters that stand alone.
METRIC_UNITS = (
    "users|customers|clients|subscribers|requests|transactions|downloads|installs|records|rows|queries|sessions|impressions|views|engineers|developers|designers|people|person|members|employees|contractors|reports|hires"
    "|weeks|days|months|years|hours|quarters|sprints|countries|markets|regions|teams|products|features|projects|patents|publications|languages|services"
)
BOLD_METRIC = (
    "(?i)([$][0-9][0-9,]*(?:[.][0-9]+)?\\s?[KMB]?[+]?(?:\\s(?:ARR|MRR|revenue))?|~?[0-9][0-9,]*(?:[.][0-9]+)?%[+]?|(?:\\b[0-9][0-9,]*(?:[.][0-9]+)?x\\b)"
    f"|(?:\\b[0-9][0-9,]*(?:[.][0-9]+)?\\s?[KMB]?[+]?[-\\s](?:{METRIC_UNITS})(?:\\s(?:team|org|organization))?))"
)
CHAT_OPENER, LIST_MARK = "(?i)^here (?:are|is) (?:the )?rewritten\\b", "^(?:[0-9]+[.)]\\s+|[•\\-]\\s*|[*]\\s+)"
LONE_BULLET = "^\\s*[•●▪◦‣▶►·�]\\s*$"
PROMPT_ECHO = ("rules:", "original bullets:", "rewritten bullets:", "original:", "rewritten:")
