"""Word lists and rewrite tables of the compression rules.

FIXED VALUES: everything in this module is data that decides the results, so it
is stated literally and in its natural order (the order of a table is the order
in which its rules apply, unless a rule says "longest first").
"""

# Words without meaning of their own; dropped from prose lines.
STOP_WORDS = [
    # German: articles, pronouns, intensifiers
    "der", "die", "das", "ein", "eine", "einer", "einem", "eines",
    "den", "dem", "des",
    "mich", "dich", "sich",
    "seine", "seiner", "seinen", "seinem",
    "ihrer", "ihrem", "ihren",
    "diese", "dieser", "diesem", "diesen",
    "sehr", "auch",
    # English: articles, copula, pronouns, intensifiers
    "the", "a", "an",
    "is", "are", "was", "were", "be", "been", "being",
    "has", "have", "had", "do", "does", "did",
    "me", "him", "her", "it", "we", "they",
    "its", "my", "your", "his", "our", "their",
    "this", "that", "these", "those",
    "very", "just", "really", "quite", "rather",
    "also", "too",
]

# Dropped only from lines of more than eight words.
EXTRA_STOP_WORDS = [
    "then", "there", "here", "where", "while",
    "each", "every", "both", "some",
    "such", "same", "other", "own",
    "shall",
    "only", "even", "still",
    "yet",
]

# Phrases that add nothing; removed whole, longest first.
FILLER_PHRASES = [
    "it is important to note that",
    "it should be noted that",
    "it is worth mentioning that",
    "in order to",
    "as a matter of fact",
    "at the end of the day",
    "in terms of",
    "with respect to",
    "with regard to",
    "due to the fact that",
    "for the purpose of",
    "in the event that",
    "on the other hand",
    "as a result of",
    "in addition to",
    "as well as",
    "at this point in time",
    "in the process of",
    "it goes without saying that",
    "needless to say",
    "please note that",
    "please be aware that",
    "as mentioned above",
    "as previously mentioned",
    "as described above",
    "as shown below",
    "as you can see",
    "basically",
    "essentially",
    "fundamentally",
    "generally speaking",
    "in general",
    "es ist wichtig zu beachten dass",
    "es sollte beachtet werden dass",
    "im folgenden",
    "im grunde genommen",
    "darüber hinaus",
    "nichtsdestotrotz",
    "grundsätzlich",
    "selbstverständlich",
    "meiner meinung nach",
]

# Word or phrase -> shorter form. An empty form drops the word; drops run last.
SYNONYMS = {
    "approximately": "~",
    "functionality": "feature",
    "implementation": "impl",
    "configuration": "config",
    "documentation": "docs",
    "application": "app",
    "information": "info",
    "requirements": "reqs",
    "environment": "env",
    "development": "dev",
    "production": "prod",
    "repository": "repo",
    "dependency": "dep",
    "dependencies": "deps",
    "authentication": "auth",
    "authorization": "authz",
    "database": "db",
    "directory": "dir",
    "parameter": "param",
    "parameters": "params",
    "maximum": "max",
    "minimum": "min",
    "specification": "spec",
    "specifications": "specs",
    "administrator": "admin",
    "temporary": "temp",
    "initialize": "init",
    "initialized": "init'd",
    "utilization": "usage",
    "utilise": "use",
    "utilize": "use",
    "modification": "mod",
    "modifications": "mods",
    "automatically": "auto",
    "previously": "prev",
    "additionally": "also",
    "unfortunately": "",
    "corresponding": "matching",
    "respectively": "each",
    "executable": "exe",
    "execution": "exec",
    "management": "mgmt",
    "manager": "mgr",
    "notification": "notif",
    "notifications": "notifs",
    "registration": "reg",
    "connection": "conn",
    "connections": "conns",
    "function": "fn",
    "functions": "fns",
    "variable": "var",
    "variables": "vars",
    "component": "comp",
    "components": "comps",
    "performance": "perf",
    "operation": "op",
    "operations": "ops",
    "package": "pkg",
    "packages": "pkgs",
    "message": "msg",
    "messages": "msgs",
    "response": "resp",
    "request": "req",
    "requests": "reqs",
    "number": "num",
    "numbers": "nums",
    "address": "addr",
    "addresses": "addrs",
    "reference": "ref",
    "references": "refs",
    "argument": "arg",
    "arguments": "args",
    "attribute": "attr",
    "attributes": "attrs",
    "exception": "exc",
    "expression": "expr",
    "description": "desc",
    "permissions": "perms",
    "permission": "perm",
    "certificate": "cert",
    "certificates": "certs",
    "encryption": "enc",
    "middleware": "mw",
    "interface": "iface",
    "interfaces": "ifaces",
    "memory": "mem",
    "object": "obj",
    "objects": "objs",
    "available": "avail",
    "library": "lib",
    "libraries": "libs",
    "following": "below",
    "necessary": "needed",
    "however": "but",
    "therefore": "so",
    "although": "tho",
    "because": "bc",
    "without": "w/o",
    "between": "btwn",
    "through": "thru",
    "different": "diff",
    "including": "incl",
    "contains": "has",
    "containing": "with",
    "provides": "gives",
    "currently": "now",
    "specific": "",
    "individual": "",
    "particular": "",
    "appropriate": "",
    "respective": "",
    "especially": "esp",
    "significant": "major",
    "immediately": "now",
    "completely": "fully",
    "separately": "apart",
    "typically": "usually",
    "whether": "if",
    "multiple": "many",
    "requires": "needs",
    "required": "needed",
    "existing": "current",
    "throughout": "across",
    "consistently": "always",
    "permanently": "forever",
    "recommended": "rec'd",
    "successfully": "ok",
    "originally": "was",
    "within": "in",
    "should be": "→",
    "needs to be": "→",
    "must be": "→",
}

# Wordy pattern -> compact form; applied longest pattern first.
VERBOSE_PATTERNS = [
    (r"\bis able to\b", "can"),
    (r"\bare able to\b", "can"),
    (r"\bin order to\b", "to"),
    (r"\bfor the purpose of\b", "to"),
    (r"\bwith the aim of\b", "to"),
    (r"\bso as to\b", "to"),
    (r"\bmake sure\b", "ensure"),
    (r"\bmake certain\b", "ensure"),
    (r"\btake advantage of\b", "use"),
    (r"\btake into account\b", "consider"),
    (r"\btakes into account\b", "considers"),
    (r"\bgive rise to\b", "cause"),
    (r"\bcome up with\b", "create"),
    (r"\bcarry out\b", "run"),
    (r"\bcarried out\b", "ran"),
    (r"\bset up\b", "setup"),
    (r"\bput together\b", "assemble"),
    (r"\bget rid of\b", "remove"),
    (r"\bend up\b", "become"),
    (r"\ba large number of\b", "many"),
    (r"\ba small number of\b", "few"),
    (r"\ba wide range of\b", "many"),
    (r"\ba variety of\b", "various"),
    (r"\bon a regular basis\b", "regularly"),
    (r"\bat the same time\b", "simultaneously"),
    (r"\bat a later time\b", "later"),
    (r"\bat a later date\b", "later"),
    (r"\bin the majority of cases\b", "usually"),
    (r"\bin most cases\b", "usually"),
    (r"\bin some cases\b", "sometimes"),
    (r"\bin many cases\b", "often"),
    (r"\bin the case of\b", "for"),
    (r"\bin the context of\b", "in"),
    (r"\bin the absence of\b", "without"),
    (r"\bin the presence of\b", "with"),
    (r"\bin conjunction with\b", "with"),
    (r"\bin accordance with\b", "per"),
    (r"\bin relation to\b", "about"),
    (r"\bin close proximity to\b", "near"),
    (r"\bprior to\b", "before"),
    (r"\bsubsequent to\b", "after"),
    (r"\bwith the exception of\b", "except"),
    (r"\bfor the sake of\b", "for"),
    (r"\bby means of\b", "via"),
    (r"\bby way of\b", "via"),
    (r"\bas a consequence of\b", "bc"),
    (r"\bon the basis of\b", "based on"),
    (r"\bon behalf of\b", "for"),
    (r"\bup to this point\b", "so far"),
    (r"\bat the present time\b", "now"),
    (r"\bat the current time\b", "now"),
    (r"\bas of right now\b", "now"),
    (r"\bfor the time being\b", "now"),
    (r"\buntil such time as\b", "until"),
    (r"\bregardless of whether\b", "whether"),
    (r"\birrespective of\b", "regardless"),
    (r"\bthe ability to\b", "can"),
    (r"\bhas the ability to\b", "can"),
    (r"\bprovides the ability to\b", "enables"),
    (r"\bthe fact that\b", "that"),
    (r"\bdue to the fact that\b", "bc"),
    (r"\bin spite of the fact that\b", "despite"),
    (r"\bregardless of the fact that\b", "even tho"),
    (r"\bit is possible to\b", "can"),
    (r"\bit is necessary to\b", "must"),
    (r"\bit is recommended to\b", "should"),
    (r"\bit is important to\b", "should"),
    (r"\bit is essential to\b", "must"),
    (r"\bthere is a need to\b", "must"),
    (r"\bthere is no need to\b", "needn't"),
    (r"\bwhen it comes to\b", "for"),
    (r"\bas far as .{1,20} (?:is|are) concerned\b", "about"),
    (r"\bthe purpose of .{1,30} is to\b", ""),
    (r"\bin such a way that\b", "so"),
    (r"\bto a large extent\b", "mostly"),
    (r"\bto a certain extent\b", "partly"),
    (r"\bto some extent\b", "partly"),
    (r"\bon the other hand\b", "but"),
    (r"\bas opposed to\b", "vs"),
    (r"\bas compared to\b", "vs"),
    (r"\bin comparison to\b", "vs"),
    (r"\bas long as\b", "if"),
    (r"\bprovided that\b", "if"),
    (r"\bin the event that\b", "if"),
    (r"\bin the event of\b", "if"),
    (r"\bgiven that\b", "since"),
    (r"^(?:Please )?(?:note|be aware|keep in mind) that ", ""),
    (r"^It (?:should|must|is important to) be (?:noted|mentioned|emphasized) that ", ""),
    (r"^It is worth (?:noting|mentioning|pointing out) that ", ""),
    (r"^(?:As|Like) (?:we )?(?:mentioned|discussed|noted|described|stated) "
     r"(?:above|earlier|before|previously),? ?", ""),
    (r"\bcan be used to\b", "can"),
    (r"\bis used to\b", "does"),
    (r"\bare used to\b", "do"),
    (r"\bcan be found in\b", "is in"),
    (r"\bcan be seen in\b", "is in"),
    (r"\bshould be configured\b", "configure"),
    (r"\bmust be configured\b", "configure"),
    (r"\bneeds to be configured\b", "configure"),
    (r"\bshould be installed\b", "install"),
    (r"\bmust be installed\b", "install"),
    (r"\bneeds to be installed\b", "install"),
    (r"\bshould be updated\b", "update"),
    (r"\bmust be updated\b", "update"),
    (r"\bshould be set to\b", "set to"),
    (r"\bmust be set to\b", "set to"),
    (r"\bes handelt sich um\b", "="),
    (r"\bim Rahmen von\b", "bei"),
    (r"\bim Zusammenhang mit\b", "bei"),
    (r"\bauf der Grundlage von\b", "basierend auf"),
    (r"\bunter Berücksichtigung von\b", "mit"),
    (r"\bmit dem Ziel\b", "um"),
    (r"\bzu dem Zweck\b", "um"),
    (r"\bin Bezug auf\b", "bzgl"),
    (r"\bim Hinblick auf\b", "bzgl"),
    (r"\bsowohl .{1,20} als auch\b", "und"),
    (r"\bnicht nur .{1,20} sondern auch\b", "und"),
    (r"\bauf Grund von\b", "wegen"),
    (r"\baufgrund von\b", "wegen"),
    (r"\baus diesem Grund\b", "daher"),
    (r"\bauf diese Weise\b", "so"),
]

# A line that matches keeps all of its words.
CRITICAL_LINE = (
    r"(?:\b\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\b"
    r"|(?:deadline|frist|bis zum|until|due|fällig)\b"
    r"|\b(?:TODO|FIXME|HACK|XXX|WARNING|NOTE)\b"
    r"|\bv?\d+\.\d+(?:\.\d+)?(?:-\w+)?\b"
    r"|\b\d{1,2}:\d{2}\b"
    r"|\b(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag"
    r"|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b)"
)

# Literals, of which every line matched by a word (not by digits) holds one.
CRITICAL_WORDS = [
    "deadline", "frist", "bis zum", "until", "due", "fällig",
    "todo", "fixme", "hack", "xxx", "warning", "note",
    "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
]

FANCY_BULLETS = "•●○◦▸▹►▻➤➜→"

# Smart punctuation -> ASCII.
SMART_PUNCTUATION = [
    ("\u201c", '"'), ("\u201d", '"'),
    ("\u2018", "'"), ("\u2019", "'"),
    ("\u2013", "-"), ("\u2014", "--"),
    ("\u2026", "..."),
    ("\u00a0", " "),
]

# Fence language hints whose block is always kept verbatim.
CODE_HINTS = [
    "python", "py", "javascript", "js", "typescript", "ts",
    "java", "c", "cpp", "c++", "csharp", "cs", "go", "rust",
    "ruby", "rb", "php", "swift", "kotlin", "scala", "r",
    "sql", "lua", "perl", "haskell", "html", "css", "jsx",
    "tsx", "vue", "svelte",
]
SHELL_HINTS = ["bash", "sh", "shell", "cmd", "powershell", "ps1", "zsh"]
