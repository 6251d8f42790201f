"""Fixed word lists and patterns.

Everything here is data whose values decide the results, so it is stated
plainly. Every operator that uses a list takes it as an argument and only
defaults to the value below.
"""

# English stop words (the usual 179-word list).
STOPWORDS = tuple(
    """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
)

# Security acronyms and their expansions, in lookup order.
ACRONYMS = {
    "XSS": ["Cross Site Scripting", "X Site Scripting"],
    "SQLi": ["SQL Injection", "SQL Code Injection"],
    "CSRF": ["Cross Site Request Forgery", "XSRF"],
    "RCE": ["Remote Code Execution", "Remote Command Execution"],
    "DoS": ["Denial of Service", "Attack Denial of Service"],
    "DDoS": ["Distributed Denial of Service", "Distributed DOS"],
    "APT": ["Advanced Persistent Threat", "Advanced Threat"],
    "IDS": ["Intrusion Detection System", "Intrusion Detection Software"],
    "IPS": ["Intrusion Prevention System", "Intrusion Prevention Software"],
    "IAM": ["Identity and Access Management", "Identity Access Management"],
    "MitM": ["Man in the Middle", "Man in the Middle Attack"],
    "AitM": ["Adversary in the Middle", "Adversary in the Middle Attack"],
    "IoC": ["Indicator of Compromise", "Indicators of Compromise"],
    "TTP": ["Tactics, Techniques, and Procedures", "Techniques, Tactics, and Procedures"],
    "SIEM": ["Security Information and Event Management", "Security Event Management"],
    "SOC": ["Security Operations Center", "SecOps Center"],
    "OSINT": ["Open Source Intelligence", "Open Source Intelligence"],
    "TLS": ["Transport Layer Security", "Transport Security"],
    "VPN": ["Virtual Private Network", "Virtual Networking"],
    "TOCTOU": ["Time of Check and Time of Use", "TOC/TOU Attack", "Time of Check Time of Use"],
    "LFI": ["Local File Inclusion", "Local File Injection"],
    "RFI": ["Remote File Inclusion", "Remote File Injection"],
    "XXE": ["XML External Entity", "XXE Attack"],
    "SSTI": ["Server Side Template Injection", "Server Template Injection"],
    "JWT": ["JSON Web Token", "JWT Authentication"],
    "ACL": ["Access Control List", "Access Control Logic"],
    "FIM": ["File Integrity Monitoring", "File Monitoring"],
    "CSP": ["Content Security Policy", "Security Policy"],
    "WAF": ["Web Application Firewall", "Web App Firewall"],
    "UAC": ["User Account Control", "User Access Control"],
    "EDR": ["Endpoint Detection and Response", "Endpoint Response"],
    "EPP": ["Endpoint Protection Platform", "Endpoint Protection"],
    "HPP": ["HTTP Parameter Pollution", "HTTP Pollution Attack"],
    "TACACS": ["Terminal Access Controller Access Control System", "TACACS Authentication"],
    "LDAP": ["Lightweight Directory Access Protocol", "LDAP Authentication"],
    "SAML": ["Security Assertion Markup Language", "SAML Authentication"],
    "MFA": ["Multi Factor Authentication", "Multiple Factor Authentication"],
    "FIDO": ["Fast Identity Online", "Fast Identity"],
    "WSDL": ["Web Services Description Language", "WSDL Services"],
    "BitM": ["Browser in the Middle", "Browser MITM"],
    "KNOB": ["Key Negotiation of Bluetooth Attack", "Bluetooth KNOB Attack"],
    "BIAS": ["Bluetooth Impersonation Attacks", "Bluetooth Impersonation"],
    "AitB": ["Adversary in the Browser", "Browser Attack"],
    "PTH": ["Pass the Hash", "Hash Stealing Attack"],
    "PTT": ["Pass the Ticket", "Ticket Stealing Attack"],
    "CFS": ["Cross Frame Scripting"],
    "NLP": ["Natural Language Processing", "Language Processing"],
    "MX": ["Mail Exchange", "Mail Transfer Exchange"],
    "SSI": ["Server Side Injection", "Server Injection"],
    "Ajax": ["Asynchronous JavaScript and XML", "AJAX Technology"],
}

# Version and patch phrases removed from descriptions. One
# alternation, tried left to right, case-insensitive.
VERSION_PHRASES = (
    r"\b\d+(\.\d+)*\.x before \d+(\.\d+)*",
    r"\b\d+:\d+\.\d+(\.\d+)?(\.x)?\b",
    r"\bbefore \d+:\d+\.\d+(\.\d+)?(\.x)?\b",
    r"\bversions?\b\s*\d+(\.\d+)*\b",
    r"\bversions?\b.*?\b\d+(\.\d+)*\.x",
    r"\bv\.?\s*\d+(\.\d+)*",
    r"\b(?:rc\d+)\b",
    r"\b\d+(?:\.\d+){0,2}[-.]?rc\d+\b",
    r"\b\d+(\.\d+)* and earlier",
    r"\b\d+(\.\d+)* and later",
    r"\b\d+(\.\d+)* and below",
    r"\bservice pack \d+(\.\d+)?\b",
    r"\bsp\d+(\.\d+)?\b",
    r"\branging from \b\d+(\.\d+)*.*? to \d+(\.\d+)*",
    r"\bfrom version \d+(\.\d+)* to version \d+(\.\d+)*",
    r"\bup to and including version \d+(\.\d+)*",
    r"\bbefore \d+(\.\d+)*",
    r"\bversions? \d+(\.\d+){1,2} through \d+(\.\d+){1,2}\b",
    r"\bincluding \d+(\.\d+){1,3}",
    r"\bincluding versions?\b.*?\b\d+(\.\d+)*",
    r"\bexcluding \d+(\.\d+){1,3}",
    r"\bthrough \d+(\.\d+)*",
    r"\bpatch \d+(\.\d+)*",
    r"\brelease \d+(\.\d+)*",
    r"\bbefore build \d+(\.\d+)*",
    r"\bbuild \d+(\.\d+)*",
    r"\bupdate \d+(\.\d+)*",
    r"\b(\d+(\.\d+){1,3})(, \d+(\.\d+){1,3})*( and \d+(\.\d+){1,3})?\b",
    r"\b\d+\.\d+\.\d+",
    r"\b\d+\.\d+",
    r"\b\d+\.x\b",
    r"\b\d+\.\d+\.x\b",
    r"(?<=, )\.x\b",
    r"\b\.x\b",
    r"\bCVE-\d{4}-\d{4,7}(, CVE-\d{4}-\d{4,7})*( and CVE-\d{4}-\d{4,7})?\b",
)

# Extensions whose file names are removed.
FILE_EXTENSIONS = (
    "exe", "execute", "dll", "pdf", "docx", "txt", "jpg", "jpeg", "png", "gif",
    "bmp", "tiff", "mp3", "wav", "mp4", "avi", "mkv", "zip", "rar", "tar", "gz",
    "csv", "xlsx", "pptx", "html", "xml", "json", "log",
)

# Month names and abbreviations removed with dates.
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)

# Contractions that no suffix rule expands, then the suffix rules.
IRREGULAR_CONTRACTIONS = {
    "won't": "will not",
    "can't": "cannot",
    "shan't": "shall not",
    "ain't": "are not",
    "let's": "let us",
    "y'all": "you all",
    "ma'am": "madam",
    "o'clock": "of the clock",
    "'cause": "because",
    "'tis": "it is",
    "'twas": "it was",
}
SUFFIX_CONTRACTIONS = {
    "n't": " not",
    "'re": " are",
    "'ve": " have",
    "'ll": " will",
    "'d": " would",
    "'m": " am",
}
# Words after which 's means "is" (elsewhere it is a genitive).
IS_CONTRACTION_HEADS = (
    "he", "she", "it", "that", "this", "there", "here",
    "what", "who", "where", "when", "why", "how",
)

# One CPE part letter and its label.
CPE_PARTS = {"a": "application", "h": "hardware", "o": "operating system"}

# The four cumulative text versions of a pattern.
TEXT_VERSIONS = ("Basic", "Stopwords", "Lemmatization", "Stemming")

# Keyword scoring constants.
KEYWORD_MAX = 0.3
KEYWORD_PARTIAL_MAX = 0.2
KEYWORD_RUN_BONUS = 0.05
KEYWORD_HALF_BONUS = 0.15
KEYWORD_PAIR_BONUS = 0.1
KEYWORD_MALUS = 0.01

# Severity ranges of a CVSS base score.
SEVERITY_RANGES = (
    ("Low", 0.1, 3.9),
    ("Medium", 4.0, 6.9),
    ("High", 7.0, 8.9),
    ("Critical", 9.0, 10.0),
)
