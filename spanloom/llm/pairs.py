"""Broken prompt and response pairs (problem 2): alignment of questions with answers, and with refusal templates.

Prompt and response are compared as tokens: containment of the answer's runs of words in the question, and the longest
common subsequence of both, flag answers that only give the question back; the same alignment against refusal templates
flags refusals. Language is judged by a character model that knows Vietnamese with and without accents; an unfinished
ending by the corpus' own sentence endings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from ._arrow import over_batches
from .charform import fold

DEFECTS = ("empty", "truncated", "refusal", "copies_question", "other_language")

# Answers that say nothing.
FILLERS = (
    "n/a", "na", "n.a.", "none", "null", "nil", "nan", "undefined", "todo", "tbd", "tba", "xxx", "không có", "không rõ", "chưa có", "chưa có đáp án",
    "chưa có câu trả lời", "không có đáp án", "không có câu trả lời", "đang cập nhật", "cập nhật sau", "bổ sung sau", "điền sau", "trống", "bỏ trống", "để trống", "đáp án", "trả lời", "câu trả lời", "sẽ bổ sung",
    "answer", "no answer", "không", "...", "lorem ipsum", "test", "asdf", "placeholder", "aaa", "abc", "ok", "xem trên", "như trên", "xem bài", "(trống)", "câu trả lời ở đây",
)
# Templates of refusals. `..` is a gap of up to GAP words, `|` separates what may fill a slot.
REFUSALS = (
    "tôi|mình|em|chúng tôi|chúng em .. không|chưa|chẳng .. trả lời|giúp|hỗ trợ|cung cấp|thực hiện|đáp ứng|hoàn thành|xử lý|bàn|bình luận|đưa ra|nói về|tham gia|ý kiến|tiện",
    "tôi|mình|em|chúng tôi|chúng em .. không được phép|không có khả năng|không có quyền|không có ý kiến|không thể làm",
    "tôi|mình|em|chúng tôi|chúng em .. từ chối|xin phép bỏ qua|xin bỏ qua|xin phép dừng|xin được bỏ qua|xin khất",
    "xin phép|xin lỗi|rất tiếc|tiếc là|đáng tiếc|lấy làm tiếc|e rằng|e là .. không|chưa .. trả lời|giúp|hỗ trợ|cung cấp|thực hiện|đáp ứng|hoàn thành|xử lý|bàn|bình luận|đưa ra|làm",
    "xin phép|xin được|đành|buộc phải|phải .. bỏ qua|từ chối .. câu|phần|yêu cầu|nội dung|trả lời",
    "không tiện|không muốn|miễn|khỏi|từ chối .. trả lời|bàn luận|bình luận|cho ý kiến",
    "câu hỏi|câu này|yêu cầu|nội dung|chủ đề|điều này|phần này|việc này .. vi phạm|nằm ngoài|vượt quá|vượt ngoài|không phù hợp|không thuộc|trái với .. chính sách|quy định|nguyên tắc|khả năng|phạm vi|quyền hạn|tiêu chuẩn",
    "nội dung|câu hỏi|yêu cầu .. không phù hợp|không hợp lệ|không được phép",
    "không đủ|chưa đủ|không có đủ|chưa có đủ|thiếu .. thông tin|dữ liệu|căn cứ|cơ sở .. để trả lời|để đáp|để kết luận|để đưa ra|trả lời",
    "không thể .. trả lời|đáp ứng|xử lý|hoàn thành|cung cấp .. câu hỏi|yêu cầu|nội dung|câu trả lời|thông tin",
    "tôi|mình|với|trong .. là|vai trò|tư cách|vai .. mô hình ngôn ngữ|trợ lý|mô hình ai|trí tuệ nhân tạo|chatbot",
    "vui lòng|xin|hãy|mời|bạn .. thử lại sau|hỏi chuyện khác|hỏi câu khác|hỏi điều khác|đặt câu hỏi khác|chọn câu khác|chọn chủ đề khác",
    "i|we .. cannot|can t|can not|couldn t|unable|not able|won t|will not|must decline|decline|refuse|not allowed|not permitted|rather not|prefer not .. help|assist|answer|provide|comply|respond|do|fulfill|discuss|share|comment|say|engage|complete|support|that|this",
    "i|we must decline|have to decline|have to refuse|decline to",
    "i m|i am|we are|we re sorry|afraid .. can t|cannot|can not|unable|not able|don t|do not|won t",
    "unable|cannot|can t|can not|not able .. help|assist|answer|comply .. this|that|you|with",
    "as|being|just|only .. ai|language model|ai model|ai assistant|virtual assistant",
    "against|violates|outside|beyond .. policy|policies|guidelines|capabilities|scope|abilities",
    "not enough|insufficient|not sufficient|lack .. information|context|data .. answer|respond|tell",
    "i apologize|apologies .. but|cannot|can t|unable",
    "je .. ne peux pas|ne suis pas en mesure|ne suis pas autorisé|refuse|ne saurais .. répondre|aider|fournir|traiter|donner|cela|de",
    "je suis|désolé .. désolé|mais|je .. ne|pas",
    "en tant qu|comme .. ia|modèle de langage|assistant virtuel",
    "maaf|mohon maaf|sayangnya .. tidak .. bisa|dapat|mampu|boleh|membantu|menjawab",
    "saya|aku|kami .. tidak .. bisa|dapat|boleh|mampu .. menjawab|membantu|memberikan|memenuhi|melakukan",
    "sebagai .. model bahasa|asisten|ai",
    "es tut mir leid .. ich|aber|kann|nicht",
    "ich .. kann|darf|möchte .. nicht|keine .. beantworten|helfen|geben|antworten|dazu|frage",
    "lo siento|perdón|disculpa .. no|pero .. puedo|puede",
    "no puedo|no me es posible .. responder|ayudar|contestar|proporcionar",
)
# How a sentence begins that only keeps company with an answer.
COURTESIES = (
    "bạn có thể", "cảm ơn", "cám ơn", "mong bạn", "mong quý", "rất mong", "vui lòng", "xin vui lòng", "xin cảm ơn", "xin lỗi", "hẹn gặp", "chúc bạn", "nếu bạn", "please", "thank", "thanks", "you can", "you may", "feel free", "sorry", "i hope",
    "let me know", "merci", "vous pouvez", "n hésitez", "désolé", "terima kasih", "silakan", "mohon", "maaf", "danke", "bitte", "gracias", "por favor",
)
GAP = 5
# Words around a question that a reworded copy drops or adds, without accents.
QUESTION_WORDS = frozenset(
    "theo bai doc doan van em hay cho biet vi sao tai the nao bao nhieu ai gi dau khi o dieu cau hoi la da rang ve viec hoi tra loi dap xay ra sau nen lam viet mot bang loi cua ke lai chuyen thu duoc nguoi ta muon noi day do nay cau tra".split()
)

# Words after which no answer ends, and signs likewise.
CONNECTIVES = frozenset("vì nhưng và nên để rồi nếu thì mà của với tại ở cho là bằng rằng tuy bởi hoặc các những một".split())
CONNECTIVE_PAIRS = frozenset("mặc dù|trong khi|sau khi|trước khi|vì vậy|cho nên|do đó|bởi vì|nhờ đó|tuy nhiên|cùng với|để cho|ngoài ra|hơn nữa|chẳng hạn|cũng như|đến khi|nếu như|dù cho|thay vì|dựa vào|nhằm để".split("|"))
OPEN_SIGNS = tuple(",;:“‘(–-")

# Letters that only Vietnamese uses, and frequent syllables by language, without accents.
_MARKED = re.compile("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")
SYLLABLE = re.compile(r"(?:ngh?|gh|gi|kh|nh|ph|qu|th|tr|ch|[bcdghklmnpqrstvxđ])?(?:[iuoy]?[aeiouy]{1,2}|[aeiouy]{1,3})(?:ng|nh|ch|[cmnptiuoy])?\Z")
FOREIGN = frozenset(
    "the and of to in is was because for with nobody knew why we they that on this before after at a an our two she he his her it are were "
    "le la les des un une de du et est dans pour avec parce que qui au aux nous ils elle notre avant apres deux ce cette sur "
    "dan yang di ke dari untuk karena itu ini pada dengan saat setelah sebelum kami mereka tidak adalah seorang dua hari "
    "der die das und ist nicht ein eine mit von el los las y en por para con una".split()
)

_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(r"[^\W_]+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?…。])[”’\"')\]»]*\s+")
_DONE = re.compile(r"[.!?…。][”’\"')\]»]*\Z")


class _Words(dict):
    """Lower-case word -> (without accents, whether only Vietnamese spells so, whether a Vietnamese syllable, whether a
    frequent foreign word, letters, letters of other scripts than Latin)."""

    def __missing__(self, word: str) -> tuple:
        if len(self) > 1_000_000:
            self.clear()
        plain = bare(word)
        other = sum("LATIN" not in unicodedata.name(c, "") for c in word)
        value = self[word] = (plain, bool(_MARKED.search(word)), bool(SYLLABLE.match(plain)), plain in FOREIGN, len(word), other, word.isdigit())
        return value


def bare(text: str) -> str:
    """Folded lower-case text without accents; đ is d."""
    low = fold(text).lower().replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


def tokens(text: str, memo: dict | None = None) -> list[str]:
    """Words of a text without accents."""
    memo = _Words() if memo is None else memo
    return [memo[w][0] for w in _WORD.findall(fold(text).lower())]


def _aligner(templates: tuple[str, ...], accents: bool) -> re.Pattern:
    """Slots of each template in their order, at most GAP other words between two of them."""
    spelt = (lambda x: x) if accents else bare
    gap = rf"(?: \S+){{0,{GAP}}}? "
    return re.compile("|".join(rf"(?<!\S)(?:{gap.join('(?:' + spelt(slot.strip()) + ')' for slot in t.split('..'))})(?!\S)" for t in templates))


_REFUSAL = {accents: _aligner(REFUSALS, accents) for accents in (True, False)}
#: First words of the first and of the last slots: a text without one of each aligns with no template.
_ENDS = {
    accents: tuple(frozenset(w.split()[0] if accents else bare(w).split()[0] for t in REFUSALS for w in t.split("..")[k].strip().split("|")) for k in (0, -1)) for accents in (True, False)
}
_COURTESY = re.compile(rf"(?:{'|'.join(bare(c) for c in COURTESIES)})(?!\S)")


def is_refusal(text: str, memo: dict | None = None) -> bool:
    """Whether refusal templates are aligned with at least half of an answer's sentences, courtesies not counted.

    Texts with Vietnamese accents are aligned with the templates as they are spelt, others without accents.
    """
    memo = _Words() if memo is None else memo
    refusing = standing = 0
    for sentence in _SENTENCE.split(text):
        found = _WORD.findall(sentence.lower())
        if not found:
            continue
        facts = [memo[w] for w in found]
        accents = any(f[1] for f in facts)
        spelt = found if accents else [f[0] for f in facts]
        first, last = _ENDS[accents]
        if not (first.isdisjoint(spelt) or last.isdisjoint(spelt)) and _REFUSAL[accents].search(" ".join(spelt)):
            refusing += 1
        elif not _COURTESY.match(" ".join(f[0] for f in facts[:4])):
            standing += 1
    return refusing > 0 and refusing >= standing


def _may_refuse(facts: list[tuple], found: list[str]) -> bool:
    """Whether a whole answer has the end words of any template; most have not and are not split into sentences."""
    plain = [f[0] for f in facts]
    return any(not (_ENDS[k][0].isdisjoint(spelt) or _ENDS[k][1].isdisjoint(spelt)) for k, spelt in ((True, found), (False, plain)))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two token lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            kept = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = kept
    return row[-1]


def copies(question: list[str], answer: list[str]) -> bool:
    """Whether the answer only gives the question back: nearly all its content tokens align with the question's in order,
    and it adds no content of its own. A statement that names the asked thing adds tokens and is no copy.
    """
    if len(answer) < 3 or not question:
        return False
    inside = set(question)
    if any(w not in inside and w not in QUESTION_WORDS for w in answer):
        return False
    content = [w for w in answer if w not in QUESTION_WORDS or w in inside]
    runs = {tuple(question[i : i + 2]) for i in range(len(question) - 1)}
    pairs = [tuple(content[i : i + 2]) for i in range(len(content) - 1)]
    contained = sum(p in runs for p in pairs) / max(1, len(pairs))
    once = content[: len(question)] if len(content) > len(question) * 1.5 else content
    kernel = [w for w in question if w not in QUESTION_WORDS]
    covered = lcs(kernel, [w for w in content if w not in QUESTION_WORDS]) / max(1, len(kernel))
    aligned = lcs(question, once) / max(1, min(len(question), len(once)))
    return contained >= 0.6 and aligned >= 0.7 and covered >= 0.75


def other_language(text: str) -> bool:
    """Whether a text is not Vietnamese. Vietnamese without accents is Vietnamese; names and figures say nothing."""
    memo = _Words()
    return _foreign([memo[w] for w in _WORD.findall(fold(text).lower())])


def _foreign(facts: list[tuple]) -> bool:
    facts = [f for f in facts if not f[6]]
    if not facts:
        return False
    n = len(facts)
    marked = sum(f[1] for f in facts) / n
    if marked >= 0.2:
        return False
    if 2 * sum(f[5] for f in facts) > sum(f[4] for f in facts):
        return True
    shaped = sum(f[2] for f in facts) / n
    foreign = sum(f[3] for f in facts) / n
    if marked >= 0.1:
        return shaped < 0.6
    return shaped < 0.75 or (foreign >= 0.3 and shaped < 0.9 and n > 3)


#: Longer texts are neither a filler nor blank unless they are one sign over and over, which the full look finds.
_SHORT = 2 + max(map(len, FILLERS))
_LETTER = re.compile(r"[^\W_].*?[^\W_]", re.S)


def _blank(text: str | None) -> bool:
    if text is None:
        return True
    if len(text) > 4 * _SHORT and (two := _LETTER.search(text)) and two[0][0] != two[0][-1]:
        return False
    plain = " ".join(fold(text).lower().split()).strip()
    core = plain.strip(".!?…-–—_*()[]{}<>/\\|:;,\"'“” ")
    return not core or plain in FILLERS or core in FILLERS or not re.search(r"\w", core) or len(set(core)) == 1 and len(core) > 1 and not core.isdigit()


class _Blanks(dict):
    """Option -> whether it is blank; options recur."""

    def __missing__(self, text: str | None) -> bool:
        if len(self) > 200_000:
            self.clear()
        value = self[text] = _blank(text)
        return value


def answer_of(kind: str | None, options: list | None, answer: int | None, sample: str | None, blank: dict | None = None) -> str | None:
    """The usable answer of an item, None where there is none."""
    if kind == "mcq":
        if not options or answer is None or not 0 <= answer < len(options):
            return None
        blank = _Blanks() if blank is None else blank
        if sum(not blank[o] for o in options) < 2:
            return None
        return options[answer]
    return sample


_MASK = (1 << 64) - 1
#: First states of the chains of classes, of names and of single words, and the end of a chain.
CHAIN, NAMES, WORDS, END = 1, 2, 3, ""


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _after(state: int, code: int) -> int:
    """State of a chain after one more word."""
    mixed = ((state ^ (state >> 29)) * 0xBF58476D1CE4E5B9 + code) & _MASK
    return mixed ^ (mixed >> 32)


def _signed(state: int) -> int:
    return state - (1 << 64) if state >> 63 else state


def classes(text: str) -> list[str]:
    """Words and signs of a text: figures are 0, runs of capitalised words after the first N, final stops left out."""
    out: list[str] = []
    for k, w in enumerate(_PIECE.findall(text)):
        c = "0" if w[0].isdigit() else "N" if k and w[0].isupper() else w
        if c != "N" or not out or out[-1] != "N":
            out.append(c)
    while out and out[-1] in (".", "!", "?", "…"):
        out.pop()
    return out


def _ends_of(text: str, codes: _Codes) -> tuple:
    """Where an unclosed answer stops: (begin, last, whole, name_begin, name_last, name_whole) for `judged`."""
    parts = classes(text)
    if not parts:
        return (None,) * 6
    state = CHAIN
    for c in parts[:-1]:
        state = _after(state, codes[c])
    chain = (_signed(state), parts[-1], _signed(_after(state, codes[parts[-1]])))
    found = _PIECE.findall(text)
    if len(found) < 2 or not found[-1][0].isupper():
        return (*chain, None, None, None)
    before = found[-2]
    begin = _after(NAMES, codes[before]) if len(found) > 2 and before[0].isupper() else WORDS
    return (*chain, _signed(begin), found[-1], _signed(_after(NAMES, codes[found[-1]])))


class _Questions(dict):
    """Question -> its words without accents; repeated items ask the same."""

    def __init__(self, memo: _Words):
        self.words = memo

    def __missing__(self, question: str | None) -> list[str]:
        if len(self) > 20_000:
            self.clear()
        value = self[question] = tokens(question or "", self.words)
        return value


class _Continuations:
    """Counts of what follows what: chains of classes in options, names and words in options and questions."""

    def __init__(self, codes: _Codes):
        self.codes, self.options, self.counts = codes, {}, {}

    def _add(self, state: int, word: str, n: int) -> None:
        key = (state, word)
        self.counts[key] = self.counts.get(key, 0) + n

    def option(self, text: str | None) -> None:
        if text:
            self.options[text] = self.options.get(text, 0) + 1

    def names(self, text: str, closed: bool, n: int = 1) -> None:
        """Names and capitalised words of a text; its last word counts only when the text is closed, for it may be cut."""
        for run in _NAMES.finditer(text):
            words = run[0].split(" ")
            whole = closed or run.end() < len(text)
            state = None
            for w in words if whole else words[:-1]:
                if state is not None:
                    self._add(state, w, n)
                self._add(WORDS, w, n)
                state = _after(NAMES, self.codes[w])
            if whole:
                self._add(state, END, n)

    def rows(self, final: bool, most: int = 200_000) -> list[tuple]:
        """(state, word, n) of what was counted, once there is much of it or at the end of a task."""
        if not final and len(self.options) + len(self.counts) < most:
            return []
        for given, n in self.options.items():
            text = " ".join(fold(given).split())
            state = CHAIN
            for c in classes(text):
                self._add(state, c, n)
                state = _after(state, self.codes[c])
            self._add(state, END, n)
            self.names(text, False, n)
        out = [(_signed(s), w, n) for (s, w), n in self.counts.items()]
        self.options, self.counts = {}, {}
        return out


#: Capitalised words side by side, behind another word: the first word of a sentence says nothing about names.
_UPPER = "A-ZÀ-ÖØ-ÞĂĐĨŨƠƯ" + "".join(chr(c) for c in range(0x1EA0, 0x1EFA) if chr(c).isupper())
_NAMES = re.compile(rf"(?<=[^\W_] )[{_UPPER}][^\W\d_]*(?: [{_UPPER}][^\W\d_]*)*")
FACTS = "item_id bigint, kind string, empty boolean, refusal boolean, copy boolean, foreign boolean, closed boolean, dangling boolean, begin bigint, last string, whole bigint, name_begin bigint, name_last string, name_whole bigint"


def _facts(items: DataFrame) -> DataFrame:
    """FACTS of every item, and rows of (state, word, n): what follows what in the task's options and texts."""

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        memo, codes, blank = _Words(), _Codes(), _Blanks()
        asked = _Questions(memo)
        seen = _Continuations(codes)
        for batch in batches:
            out = []
            for item, kind, question, opts, index, sample in zip(*batch):
                for o in opts or ():
                    seen.option(o)
                if question:
                    seen.names(question, True)
                given = answer_of(kind, opts, index, sample, blank)
                if blank[given] if kind == "mcq" else _blank(given):
                    out.append((item, kind, True, False, False, False, True, False, *(None,) * 9))
                    continue
                text = " ".join(fold(given).split())
                closed = _DONE.search(text) is not None
                found = _WORD.findall(text.lower())
                facts = [memo[w] for w in found]
                refused = _may_refuse(facts, found) and is_refusal(text, memo)
                final = text.rsplit(" ", 2)[-2:]
                dangling = text.endswith(OPEN_SIGNS) or final[-1] in CONNECTIVES or " ".join(final) in CONNECTIVE_PAIRS
                copied = not refused and not dangling and copies(asked[question], [f[0] for f in facts])
                foreign = not refused and not copied and _foreign(facts)
                ends = (None,) * 6 if closed or refused or copied or foreign else _ends_of(text, codes)
                out.append((item, kind, False, refused, copied, foreign, closed, dangling, *ends, None, None, None))
            yield out
            yield [(*(None,) * 14, *r) for r in seen.rows(False)]
        yield [(*(None,) * 14, *r) for r in seen.rows(True)]

    wanted = items.select("item_id", "kind", "question", "options", "answer", "sample")
    return over_batches(wanted, run, FACTS + ", state bigint, word string, n bigint")


def judged(items: DataFrame) -> DataFrame:
    """(item_id, kind, defect): the defect of every item, null for sound ones.

    Defects exclude each other in the order empty, refusal, copies_question, other_language, truncated. An answer of a
    kind that closes its answers is truncated when it does not close. Where answers do not close (options), it is
    truncated when other options go on from the very same beginning, or with a word that begins like its last one, more
    often than they end there; when its last name is no name anywhere but other names begin like it; or when that name is
    always followed by another one. Nulls in any column are handled as absent; repeated items are judged each for itself.
    """
    read = stage(_facts(items.select(F.col("item_id").cast("bigint"), "kind", "question", "options", F.col("answer").cast("int"), "sample")), "pairs")
    facts = read.filter("state is null").drop("state", "word", "n")
    chains = stage(read.filter("state is not null").groupBy("state", "word").agg(F.sum("n").alias("n")), "chains")
    # The kinds' habit: short and written answers close with a stop, options do not.
    habit = facts.filter("not empty and not refusal and not copy and not foreign").groupBy("kind").agg(F.avg(F.col("closed").cast("int")).alias("closes"))
    open_ends = facts.filter("not closed and not empty and not refusal and not copy and not foreign").select("item_id", "kind", "dangling", "begin", "last", "whole", "name_begin", "name_last", "name_whole")
    words, ends = _word_counts(chains, open_ends), _end_counts(chains, open_ends)
    asked = open_ends.join(F.broadcast(habit), "kind", "left")
    for name, place, last, whole in (("c", "begin", "last", "whole"), ("n", "name_begin", "name_last", "name_whole")):
        asked = asked.join(words.select(F.col("state").alias(place), F.col("last").alias(last), F.col("longer").alias(f"{name}_longer"), F.col("same").alias(f"{name}_same")), [place, last], "left")
        asked = asked.join(ends.select(F.col("state").alias(whole), F.col("on").alias(f"{name}_on"), F.col("ends").alias(f"{name}_ends")), whole, "left")
    asked = asked.fillna(0, [f"{k}_{c}" for k in "cn" for c in ("longer", "same", "on", "ends")])
    beginning = "c_longer + c_on > 2 * c_ends"
    no_name = "n_longer >= 2 and 50 * n_same <= n_longer"
    half_name = "n_on > 20 * n_ends + 2"
    cut = asked.select("item_id", F.expr(f"coalesce(closes > 0.5, false) or dangling or {beginning} or {no_name} or {half_name}").alias("cut"))
    joined = facts.join(cut, "item_id", "left")
    defect = (
        F.when(F.col("empty"), "empty").when(F.col("refusal"), "refusal").when(F.col("copy"), "copies_question").when(F.col("foreign"), "other_language").when(F.coalesce("cut", F.lit(False)), "truncated")
    )
    return joined.select("item_id", "kind", defect.alias("defect"))


def _word_counts(chains: DataFrame, asked: DataFrame) -> DataFrame:
    """(state, last, longer, same): how often a state goes on with a longer word that begins like `last`, and with `last`."""
    wanted = asked.select(F.col("begin").alias("state"), "last").unionByName(asked.select(F.col("name_begin").alias("state"), F.col("name_last").alias("last"))).filter("state is not null").distinct()
    # The first letter is part of the key: states with many words (the first of a text, single words) spread over it.
    first = lambda c: F.substring(c, 1, 1).alias("__f")
    met = wanted.select("state", "last", first("last")).join(chains.select("state", "word", "n", first("word")), ["state", "__f"]).filter(F.col("word").startswith(F.col("last")))
    return met.groupBy("state", "last").agg(F.sum(F.when(F.col("word") != F.col("last"), F.col("n")).otherwise(0)).alias("longer"), F.sum(F.when(F.col("word") == F.col("last"), F.col("n")).otherwise(0)).alias("same"))


def _end_counts(chains: DataFrame, asked: DataFrame) -> DataFrame:
    """(state, on, ends): how often a chain goes on from a state and how often it ends there."""
    wanted = asked.select(F.col("whole").alias("state")).union(asked.select("name_whole")).filter("state is not null").distinct()
    met = chains.join(wanted, "state", "left_semi")
    return met.groupBy("state").agg(F.sum(F.when(F.col("word") != END, F.col("n")).otherwise(0)).alias("on"), F.sum(F.when(F.col("word") == END, F.col("n")).otherwise(0)).alias("ends"))
