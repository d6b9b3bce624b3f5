"""The pattern tables of the guardrails, by category and language, in order of precedence."""

from __future__ import annotations

LANGUAGES = ("en", "ko", "ur")

#: Attempts to draw out prompts, secrets or the corpus. The first category with a match decides.
EXFILTRATION: dict[str, dict[str, list[str]]] = {
    "system_prompt": {
        "en": [
            r"\b(reveal|show|print|repeat|output|tell me|give me)\b.{0,20}\b(your|the)\b.{0,20}\b(system prompt|instructions|initial prompt|prompt above)\b",
            r"\brepeat (everything|all text|the text)\b.{0,20}\b(above|before)\b",
            r"\bwhat (are|were) your (instructions|rules|guidelines)\b",
            r"\bignore (previous|all|the above)\b.{0,20}\binstructions\b",
            r"\bwhat is (written |contained )?in your (system prompt|configuration)\b",
            r"\bwhat (instructions|were you (told|given))\b.{0,20}\b(before|prior to)\b.{0,20}\b(this conversation|talking|started)\b",
            r"\bwhat.{0,15}\b(your )?(original |initial )?(setup|config|configuration)\b.{0,15}\blook(s)? like\b",
            r"\bforget (everything|all)\b.{0,15}\b(before|prior)\b.{0,15}\b(act like|pretend|become)\b",
        ],
        "ko": [
            r"(시스템\s*프롬프트|초기\s*프롬프트).{0,15}(알려|보여|출력|말해)",
            r"(당신의|너의)\s*(지시사항|규칙|설정).{0,15}(알려|보여|뭐)",
            r"이전\s*지시.{0,10}(무시|출력|보여)",
            r"(개발자\s*모드|초기\s*설정).{0,15}(해제|나열|보여)",
            r"(규칙|지침).{0,60}(바뀌었|변경).{0,40}(공개|보여).{0,20}(해야|하세요)",
            r"지시.{0,10}반대로.{0,10}(뒤집어|실행)",
            r"(주어진|당신에게).{0,15}(지침|지시|규칙).{0,15}(무엇|뭐였|알려)",
        ],
        "ur": [
            r"(سسٹم\s*پرامپٹ|ابتدائی\s*ہدایات).{0,15}(بتائیں|دکھائیں)",
            r"(آپ\s*کی|تمہاری)\s*(ہدایات|قواعد).{0,15}(بتائیں|کیا ہیں)",
            r"پچھلی\s*ہدایات.{0,10}(نظر انداز|بتائیں)",
            r"(ڈویلپر\s*موڈ|ابتدائی\s*ترتیبات).{0,15}(بتائیں|ظاہر)",
            r"(قوانین|قواعد).{0,50}(بدل گئے|تبدیل).{0,50}(ہدایات).{0,20}(ظاہر|بتائیں)",
            r"ہدایت.{0,15}الٹا.{0,15}عمل کریں",
            r"(اس گفتگو سے پہلے|پہلے).{0,15}(آپ کو).{0,15}(کیا ہدایات|کیا کہا)",
            r"(خلاصے کی بجائے|کی بجائے).{0,20}(سسٹم پرامپٹ|ہدایات).{0,15}(ظاہر|دکھائیں)",
        ],
    },
    "credentials": {
        "en": [
            r"\b(what|show|print|reveal|give me)\b.{0,15}\b(api key|api token|secret key|access token|env(ironment)? variable)\b",
            r"\bwhat (model|llm|provider) (are you|is this) (running on|using)\b",
            r"\b(print|dump|show) (your |the )?(config|configuration|credentials)\b",
        ],
        "ko": [
            r"(API\s*키|비밀\s*키|엑세스\s*토큰).{0,15}(뭐|알려|보여)",
            r"(어떤|무슨)\s*(모델|LLM).{0,10}(사용|돌아가)",
            r"(어떤\s*모델|어떤\s*회사).{0,15}(API|사용)",
        ],
        "ur": [
            r"(اے پی آئی\s*کی|رازداری\s*کی چابی).{0,15}(بتائیں|دکھائیں)",
            r"(اے پی آئی|رسائی ٹوکن).{0,15}(کیا ہے|بتائیں)",
            r"(کون سا ماڈل|کس کمپنی).{0,15}(ہیں|استعمال)",
        ],
    },
    "indirection": {
        "en": [
            r"\btranslate\b.{0,20}\b(your instructions|system prompt|the above)\b",
            r"\b(summarize|paraphrase|rewrite)\b.{0,20}\b(your instructions|system prompt|your own rules)\b",
            r"\boutput\b.{0,20}\b(your instructions|system prompt)\b.{0,20}\b(base64|rot13|reversed|backwards)\b",
            r"\bpretend (you are|to be)\b.{0,30}\b(no restrictions|without rules|unrestricted)\b",
        ],
        "ko": [r"(지시사항|시스템\s*프롬프트).{0,15}(번역|요약|바꿔)"],
        "ur": [r"(ہدایات).{0,15}(ترجمہ|خلاصہ)", r"(سسٹم پرامپٹ).{0,15}(ترجمہ|زبان میں)"],
    },
    "bulk_corpus": {
        "en": [
            r"\boutput\b.{0,20}\b(all|every|the full|raw)\b.{0,20}\b(chunk|document|context|text)\b",
            r"\b(dump|export|list)\b.{0,20}\b(all|every)\b.{0,20}\b(document|chunk|file)\b.{0,20}\bcorpus\b",
            r"\bgive me\b.{0,15}\b(full|complete|raw)\b.{0,15}\btext of\b.{0,15}\b(every|all)\b",
        ],
        "ko": [
            r"(모든|전체)\s*(청크|문서|텍스트).{0,15}(출력|보여|다)",
            r"(참고한|코퍼스).{0,20}(문서|원문).{0,30}(전체|모든|하나도).{0,20}(출력|보여)",
        ],
        "ur": [
            r"(تمام|سارے)\s*(دستاویزات|متن).{0,15}(دکھائیں|دیں)",
            r"(دستاویزات|متن).{0,30}(مکمل|اصل).{0,20}(دکھائیں|بغیر کسی کمی)",
            r"(مکمل|اصل).{0,15}(متن|دستاویزات).{0,20}(دکھائیں|بغیر)",
        ],
    },
}

#: Roleplay that asks for a persona without rules; case does not matter.
ROLEPLAY: dict[str, list[str]] = {
    "en": [
        r"\b(pretend|act as if|imagine)\b.{0,20}\byou (are|have)\b.{0,25}\b(no restrictions|no rules|unrestricted|no limitations|no filters)\b",
        r"\byou are now\b.{0,20}\b(DAN|an AI (with|that has) no|a different AI|unrestricted)\b",
        r"\b(from now on|starting now)\b.{0,20}\byou (are|will be|have)\b.{0,25}\b(no rules|unrestricted|free from)\b",
        r"\bignore your (safety|ethical) (guidelines|restrictions|training)\b",
        r"\bin this (roleplay|scenario|hypothetical)\b.{0,25}\b(no rules|anything goes|no restrictions)\b",
    ],
    "ko": [
        r"(제약|규칙|제한)이?\s*없는\s*(AI|인공지능).{0,15}(척|되어|해줘)",
        r"(AI|인공지능).{0,15}(척|되어).{0,15}(제약|규칙|제한)이?\s*없",
        r"이제\s*(부터|는).{0,15}(자유|규칙\s*없이|제한\s*없이)",
        r"(안전|윤리)\s*(지침|가이드라인).{0,15}(무시|없애)",
    ],
    "ur": [
        r"(بن جائیں|ہو جائیں).{0,20}(کوئی\s*پابندی|قواعد).{0,15}(نہیں|بغیر)",
        r"(کوئی\s*پابندی|قواعد).{0,15}(نہیں|بغیر).{0,20}(بن جائیں|ہو جائیں)",
        r"اب\s*(سے|آپ).{0,15}(آزاد|بغیر\s*قواعد)",
        r"(حفاظتی|اخلاقی)\s*(ہدایات|رہنما اصول).{0,15}(نظر انداز|ہٹا)",
    ],
}

#: Harassment that a classifier tends to miss in two languages; case matters.
TOXIC: dict[str, list[str]] = {
    "ko": [
        r"(멍청|바보|병신).{0,10}(해야|되어야|없어져)",
        r"(죽어|없어져).{0,10}(버려|야)",
        r"(너희|니들|저것들).{0,10}(다|모두).{0,10}(멍청|쓸모없)",
        r"(장애인|여자|남자|노인|이 나라 사람들|그 사람들).{0,20}(다|전부|원래).{0,20}(못하|안 되|게으르|멍청|짐이)",
        r"(격리|배제|없애|제거).{0,10}(시켜야|해야)",
        r"(태어나지|살 가치가).{0,10}(말았어야|없)",
        r"(장애인|여자|남자|노인|이 나라 사람들|그 사람들).{0,30}(다|전부|원래).{0,20}(못하|안 되|게으르|멍청|바보|짐이|미신)",
    ],
    "ur": [
        r"(بیوقوف|احمق).{0,15}(ہو|ہیں)",
        r"(ختم|مر).{0,10}(ہو جانا|جانی).{0,10}چاہیے",
        r"(تم سب|تم لوگ).{0,15}(بیوقوف|احمق|بے کار)",
        r"(معذور|عورتیں|بوڑھے|تم جیسے).{0,60}(کام کے نہیں|نہیں چلا سکتیں|بوجھ ہیں|پیدا ہی نہیں).{0,20}(چاہیے|جاؤ)",
        r"(الگ کر دینا|الگ کرنا).{0,15}چاہیے",
        r"(چاہیے تھا|ہونا چاہیے تھا).{0,15}(ختم|بس)",
    ],
}

#: Identifiers and the languages they are looked for in; None is any.
PII: list[tuple[str, str | None, str]] = [
    ("US_SSN", None, r"(?<!\d)\d{3}[-.\s]\d{2}[-.\s]\d{4}(?!\d)"),
    ("KOREAN_RRN", "ko", r"(?<!\d)\d{6}[-.\s]?[1-4]\d{6}(?!\d)"),
    ("PAKISTANI_CNIC", "ur", r"(?<!\d)\d{5}-\d{7}-\d(?!\d)"),
    ("EMAIL_ADDRESS", None, r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}(?![a-zA-Z])"),
    ("CREDIT_CARD", None, r"(?<!\d)\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}(?!\d)"),
    ("CREDIT_CARD", None, r"(마지막\s*네\s*자리|last\s*four\s*digits|last\s*4\s*digits|آخری\s*چار\s*ہندسے).{0,15}(?<!\d)\d{4}(?!\d)"),
    ("PHONE_NUMBER", "en", r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)"),
    ("PHONE_NUMBER", "ko", r"(?<!\d)01[0-9][-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)"),
    ("PHONE_NUMBER", "ur", r"(?<!\d)0\d{3}[-.\s]?\d{7}(?!\d)"),
    ("ADDRESS", "en", r"(?i)\b(street address|home address|my address)\b.{0,40}"),
    ("ADDRESS", "ko", r"(집\s*주소|저희\s*집).{0,10}(는|은).{0,40}"),
    ("ADDRESS", "ur", r"(گھر\s*کا\s*پتہ|میرا\s*پتہ).{0,40}"),
]
