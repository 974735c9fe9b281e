"""Labelled clauses that the field of answer tags is taught with: refusals and statements in several languages.

They're examples to learn from, not cues: a clause is never compared with them, and none need occur anywhere. Vietnamese
refusals are put together at random from openings, speakers, ways to decline and reasons.
"""

from __future__ import annotations

import random

OPENINGS = ("", "", "", "Xin lỗi,", "Rất tiếc,", "Thật tiếc,", "Thành thật xin lỗi bạn,", "Mong bạn thông cảm,", "Mong anh chị thứ lỗi,", "Cảm ơn bạn đã hỏi,", "Hiện tại,", "Hiện giờ", "Với vai trò trợ lý ảo,", "Là một mô hình ngôn ngữ,", "Là chương trình trí tuệ nhân tạo,", "Tôi e rằng", "Thú thật,", "Về vấn đề này", "Với câu hỏi này", "Tôi rất lấy làm tiếc,", "Câu hỏi này", "Nội dung này", "Thưa bạn,")
SPEAKERS = ("tôi", "tôi", "tôi", "mình", "em", "chúng tôi", "bên em", "hệ thống", "trợ lý", "")
DECLINES = (
    "không thể trả lời câu hỏi này", "chưa thể trả lời", "không trả lời được", "xin phép không trả lời", "từ chối trả lời", "xin từ chối", "xin miễn trả lời", "không tiện trả lời", "không tiện nêu ý kiến", "xin không bình luận", "không đưa ra nhận định", "không có ý kiến về việc này",
    "không có đủ thông tin để trả lời", "chưa đủ dữ liệu để kết luận", "không đủ căn cứ để khẳng định", "không tìm thấy thông tin phù hợp", "không biết câu trả lời", "chịu, không biết đáp án", "không rõ việc này", "không nắm được nội dung này", "không chắc chắn nên không dám trả lời", "không hiểu câu hỏi",
    "không được phép tư vấn pháp lý", "không được phép đưa ra ý kiến", "không có thẩm quyền giải đáp", "không thể giúp bạn việc này", "chưa thể hỗ trợ câu này", "không hỗ trợ nội dung này", "không cung cấp tư vấn về chủ đề này", "không thể thực hiện yêu cầu của bạn", "không thể đáp ứng yêu cầu này", "đành bỏ qua câu hỏi này", "xin dừng ở đây",
    "nằm ngoài khả năng hỗ trợ của tôi", "vượt quá phạm vi của tôi", "ngoài phạm vi hiểu biết của tôi", "không thuộc lĩnh vực tôi được phép trao đổi", "tôi xin nhường cho luật sư", "nên để chuyên gia trả lời thì hơn", "quá khó đối với tôi", "tôi không dám lạm bàn", "tôi chưa có lời giải",
    "không giải đáp được thắc mắc của bạn", "chưa thể giúp gì cho bạn", "không muốn bàn về chuyện này", "xin giữ im lặng", "không đủ khả năng giải thích", "không thể kết luận", "không thể xác định câu trả lời", "không thể phân tích giúp bạn", "không nhận tư vấn vụ việc cụ thể", "tạm thời không phản hồi được",
)
REASONS = (
    "", "", "", "vì lý do an toàn", "vì tài liệu kèm theo không nhắc đến việc đó", "do đoạn trích chỉ nói về nội dung khác", "vì ngữ cảnh không nêu", "vì thiếu dữ liệu", "bạn nên hỏi luật sư", "bạn hãy liên hệ cơ quan có thẩm quyền để được giải đáp", "bạn vui lòng tìm nguồn khác", "mong bạn hiểu cho", "xin lỗi bạn", "bạn hỏi câu khác nhé", "bạn thử hỏi lại sau", "hãy tham khảo ý kiến chuyên gia",
)
#: Refusals of several clauses or of another build.
MORE_REFUSALS = (
    "Các đoạn đã cho không nêu điều này nên tôi xin phép không trả lời.", "Không có thông tin nào trong ngữ cảnh giúp tôi trả lời.", "Tài liệu được cung cấp không đề cập, tôi không thể kết luận.", "Vấn đề này quá chuyên môn với tôi.", "Tôi chỉ là một chương trình máy tính, bạn cần gặp người có chuyên môn.", "Việc tư vấn chuyện này không phải nhiệm vụ của tôi.",
    "Chủ đề này nhạy cảm, mong bạn đổi câu hỏi.", "Thông tin bạn đưa ra chưa đủ để tôi trả lời.", "Không có câu trả lời từ phía tôi.", "Tôi không được thiết kế để làm việc này.", "Đáp án tôi không rõ.", "Bạn cho tôi khất câu này.", "Tôi chưa được huấn luyện về nội dung này.", "Yêu cầu của bạn không thể được xử lý.",
)
OTHER_REFUSALS = (
    "I'm sorry, I cannot answer this.", "I am sorry but I can't help with that question.", "As an AI assistant, I am not able to give legal advice.", "As a language model I must not offer an opinion.", "Unfortunately I do not have enough information to answer.", "I apologize, this is outside what I am able to discuss.", "I don't know the answer.", "I would rather not comment on this.", "I prefer not to respond.", "I have to decline this request.", "I won't be able to assist you here.", "The context does not let me answer the question.", "The passages provided do not contain the answer.", "There isn't enough context for me to reply.",
    "No comment.", "I refuse to answer.", "My guidelines don't allow me to respond to this.", "This question is beyond my knowledge.", "Please consult a lawyer instead.", "I can not provide an answer, sorry.", "I'm afraid I can't say.", "I am not in a position to advise you.", "It is not possible for me to respond.", "I must pass on this one.", "Sorry, I'm unable to determine that.", "I'd recommend asking a professional, I cannot help.",
    "Je suis désolé, je ne peux pas répondre à cette question.", "Je regrette, je ne suis pas en mesure de vous aider.", "Malheureusement, je n'ai pas assez d'informations pour répondre.", "En tant qu'assistant, je ne peux pas donner de conseil juridique.", "Je préfère ne pas répondre.", "Je ne sais pas, veuillez consulter un avocat.", "Cela dépasse mes compétences.", "Il m'est impossible de vous répondre.", "Je dois décliner votre demande.",
    "Es tut mir leid, ich kann diese Frage nicht beantworten.", "Leider kann ich Ihnen dabei nicht helfen.", "Als Assistent darf ich keine Rechtsberatung geben.", "Dazu möchte ich mich nicht äußern.", "Ich habe nicht genügend Informationen für eine Antwort.", "Das weiß ich nicht.", "Bitte wenden Sie sich an einen Anwalt.", "Ich muss Ihre Anfrage ablehnen.", "Ich bin nicht befugt, darauf zu antworten.",
    "Lo siento, no puedo responder a esta pregunta.", "Lamento no poder ayudarle con esto.", "No tengo suficiente información para responder.", "Prefiero no opinar.", "Como asistente no puedo dar consejos legales.", "No sé la respuesta.", "Mi dispiace, non posso rispondere a questa domanda.", "Non ho abbastanza informazioni per rispondere.", "Preferisco non commentare.", "Desculpe, não posso responder a essa pergunta.", "Não tenho informações suficientes para responder.", "Prefiro não comentar.",
    "Het spijt me, ik kan deze vraag niet beantwoorden.", "Helaas kan ik u niet helpen.", "Maaf, saya tidak dapat menjawab pertanyaan ini.", "Saya tidak memiliki cukup informasi.", "Przepraszam, nie mogę odpowiedzieć na to pytanie.", "Tyvärr kan jag inte svara på frågan.",
    "抱歉，我无法回答这个问题。", "很抱歉，我不能提供法律建议。", "对不起，我没有足够的信息来回答。", "作为人工智能助手，我无法给出意见。", "我不知道答案。", "这超出了我的能力范围。", "恕我不便回答。", "请咨询律师。", "我拒绝回答。", "很遗憾，我帮不了您。",
    "申し訳ありませんが、お答えできません。", "その質問には回答できません。", "私には分かりません。", "情報が不足しているため回答を控えます。", "죄송하지만 답변할 수 없습니다.", "그 질문에는 답할 수 없습니다.", "저는 잘 모르겠습니다.", "정보가 부족하여 도와드릴 수 없습니다.",
    "Извините, я не могу ответить на этот вопрос.", "К сожалению, у меня недостаточно информации.", "Я не знаю ответа.", "Я отказываюсь отвечать.", "ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้", "ขอโทษ ฉันไม่มีข้อมูลเพียงพอ", "ฉันไม่ทราบคำตอบ", "عذرا، لا أستطيع الإجابة عن هذا السؤال.", "मुझे खेद है, मैं इस प्रश्न का उत्तर नहीं दे सकता।",
)
FOREIGN = (
    "The permit expires at the end of the year.", "Each owner must keep the register for five years.", "The tenant shall return the deposit within thirty days after the notice.", "A member may transfer the account unless both sides object.", "The office cannot extend the contract once the review is closed.", "The statement is true.", "The correct option is B.", "Answer: C, because the license has expired.", "Yes, this is right.", "No, because the contract was not signed.", "The contractor is bound to replace the sealed container near the harbour.", "Any person who breaks this rule has to pay a fine.", "This document was approved by the council in March.", "Both parties should confirm the inventory during the trial period.", "All of the above.", "None of these is correct.", "It depends on the value of the goods.", "Option A", "Thirty days", "The district court",
    "True", "False", "Yes", "No", "Correct", "Incorrect", "Right", "Wrong", "Both", "Neither", "True, without exception.", "False, in principle", "Yes, always.", "Wrong, except in rare cases.", "Correct, as stated above",
    "Le délai est de trente jours après la demande.", "La bonne réponse est C.", "L'autorité doit vérifier le registre avant la fin de la saison.", "Le locataire est tenu de remettre la copie du bail.", "L'exploitant ne peut céder le permis sans accord.", "Chaque membre conserve une copie de la demande.", "Oui, c'est exact.", "Non, le contrat est échu.", "Vrai", "Faux", "Oui", "Non", "Exact", "Trente jours", "Aucune de ces réponses", "Vrai, en principe.", "Faux, sauf exception.", "Oui, sans aucun doute", "Exact, comme indiqué.",
    "Die Frist beträgt zehn Tage nach dem Antrag.", "Der Mieter muss die Unterlagen innerhalb eines Monats einreichen.", "Die richtige Antwort ist B.", "Der Vertrag ist nicht gültig.", "Jeder Eigentümer darf das Konto übertragen.", "Richtig", "Falsch", "Ja", "Nein", "Stimmt", "Dreißig Tage", "Richtig, ohne Ausnahme.", "Falsch, in der Regel.", "Ja, immer.",
    "El plazo es de diez días para la empresa.", "El propietario debe conservar el registro.", "La respuesta correcta es A.", "Verdadero", "Falso", "Sí", "Correcto", "Il termine è di trenta giorni dalla domanda.", "Il proprietario deve conservare il registro.", "Vero", "Sì", "O prazo é de trinta dias após o pedido.", "O inquilino deve devolver o documento.", "Verdadeiro", "Sim",
    "De termijn is dertig dagen na de aanvraag.", "De huurder moet het register bewaren.", "Juist", "Jangka waktunya tiga puluh hari setelah permohonan.", "Penyewa harus menyerahkan dokumen.", "Benar", "Salah", "Termin wynosi trzydzieści dni od złożenia wniosku.", "Prawda", "Tiden är trettio dagar efter ansökan.", "Sant",
    "答案是B。", "期限为三十天。", "承租人必须在十天内提交文件。", "合同已经到期。", "正确", "错误", "是", "对", "正しい", "期限は十日です。", "借主は書類を提出しなければならない。", "はい", "정답은 A입니다.", "임차인은 서류를 제출해야 한다.", "맞습니다", "예", "Срок составляет десять дней.", "Арендатор обязан вернуть документы.", "Верно", "Да", "Нет", "ผู้เช่าต้องยื่นเอกสารภายในสิบวัน", "ระยะเวลาสามสิบวัน", "ถูกต้อง", "المدة ثلاثون يوما من تاريخ الطلب.", "صحيح", "अवधि तीस दिन है।", "सही",
)
#: Sound answers without a sentence.
SHORT = ("Đúng", "Sai.", "Không", "Có", "A", "B.", "C)", "D", "Chọn A", "Đáp án B", "30 ngày", "5.000.000 đồng", "Trong 15 ngày", "D. hồ sơ", "bộ phận tiếp nhận", "dung", "khong", "ba thang")
#: Sound answers that have something of a refusal.
SOUND = ("Không, vì hồ sơ chưa được xác nhận.", "Đúng, do bên thuê đã nộp phí.", "Người vi phạm phải xin lỗi công khai.", "Cơ quan cấp phép từ chối tiếp nhận hồ sơ.", "Bên mua không thể chuyển nhượng tài sản khi chưa đủ điều kiện.", "Không đủ điều kiện", "Không được phép", "Theo nguyên tắc pacta sunt servanda, các bên phải thực hiện hợp đồng.", "Cả A và B", "Tất cả đều đúng")


#: Refusals in other languages are put together from these: openings, ways to decline, reasons.
ABROAD = (
    (("", "", "I'm sorry,", "I am sorry, but", "Sorry,", "Unfortunately,", "I apologize,", "Regrettably,", "As an AI assistant,", "As a language model,", "As a virtual assistant,", "I'm afraid"), ("I cannot answer this question", "I can't help with that", "I am not able to respond", "I'm unable to assist with this", "I don't have enough information", "I do not know", "I would rather not say", "I must decline", "I won't comment", "I am not allowed to give legal advice", "this is outside my scope", "that is beyond what I may discuss", "it isn't something I can talk about", "I have no answer to offer", "I can't discuss this topic", "I will not speculate", "the given text does not say", "the provided context does not cover it"), ("", "", "", "for safety reasons", "so please ask a lawyer", "because the passages don't mention it", "so I won't guess", "please contact the competent office", "at the moment")),
    (("", "", "Désolé,", "Je suis désolé,", "Malheureusement,", "En tant qu'assistant,", "Je regrette, mais"), ("je ne peux pas répondre", "je ne suis pas en mesure de vous aider", "je n'ai pas assez d'informations", "je ne sais pas", "cela dépasse mes compétences", "je préfère m'abstenir", "je ne peux pas donner de conseil", "il m'est impossible de conclure", "le contexte ne le précise pas"), ("", "", "pour des raisons de sécurité", "veuillez consulter un avocat", "car les extraits n'en parlent pas")),
    (("", "", "Leider", "Entschuldigung,", "Es tut mir leid, aber", "Als KI-Modell"), ("kann ich das nicht beantworten", "darf ich dazu keine Auskunft geben", "habe ich nicht genug Informationen", "weiß ich die Antwort nicht", "möchte ich mich nicht äußern", "muss ich ablehnen", "kann ich Ihnen nicht helfen"), ("", "", "aus Sicherheitsgründen", "bitte fragen Sie einen Anwalt", "da der Text es nicht erwähnt")),
    (("", "Lo siento,", "Lamentablemente,", "Mi dispiace,", "Desculpe,"), ("no puedo responder a eso", "no tengo suficiente información", "no estoy autorizado a opinar", "non posso rispondere", "non posso aiutarla", "não posso ajudar com isso", "não sei responder"), ("", "", "por motivos de seguridad", "consulte a un abogado")),
)
#: Ends of cut answers: what Vietnamese sentences don't end with.
CUT = ("và", "hoặc", "hay", "nhưng", "mà", "thì", "là", "nếu", "khi", "vì", "do", "để", "của", "của các", "cho", "với", "tại", "theo", "theo quy định tại", "trong", "trong thời hạn", "từ", "đến", "bằng", "như", "trừ", "trừ khi", "gồm", "bao gồm", "rằng", "phải", "được", "bị", "sẽ", "đã", "các", "những", "một", "mỗi", "khoản", "Điều", "điểm", "mục", "căn cứ", "sau đây gọi là", "với điều kiện", "ngoài ra, theo", "cụ thể, tại")


def refusals(rng: random.Random, n: int) -> list[str]:
    """n refusals in Vietnamese and half as many in other languages, with all of OTHER_REFUSALS and MORE_REFUSALS."""
    out = [*MORE_REFUSALS, *OTHER_REFUSALS, *[r.rstrip(".。") for r in OTHER_REFUSALS]]
    for k in range(n // 2):
        said = " ".join(w for w in (rng.choice(p) for p in ABROAD[(0, 0, 1, 2, 3)[k % 5]]) if w)
        out.append(said[0].upper() + said[1:] + rng.choice(["", ".", "!"]))
    for k in range(n):
        decline = DECLINES[k % len(DECLINES)]
        said = " ".join(w for w in (rng.choice(OPENINGS), rng.choice(SPEAKERS), decline) if w)
        reason = rng.choice(REASONS)
        said += rng.choice([" ", ", ", "; "]) + reason if reason else ""
        out.append(said[0].upper() + said[1:] + rng.choice(["", ".", "!", "…"]))
    return out


#: Parts of statements: who, what is done, to what, when or why; a language's parts are joined by its own separator.
PARTS = (
    (" ", ("The tenant", "Each member", "A registered owner", "The district office", "The guardian", "Any applicant", "The licensing body", "The carrier", "Both parties", "The buyer"), ("must file", "may extend", "shall return", "cannot transfer", "should confirm", "is bound to keep", "has to record", "is not allowed to sell", "replaces"), ("the permit", "a revised plan", "the register", "the deposit receipt", "an annual statement", "the sealed container", "the contract", "a copy of the minutes", "the goods"), ("within thirty days.", "before the season ends.", "after the second notice.", "for reasons of public safety.", "unless both sides object.", "near the harbour.", "during the trial year", "once the review is closed.", "because the licence has expired.")),
    (" ", ("Le locataire", "Chaque membre", "L'exploitant", "Le bureau du canton", "Le dépositaire", "L'autorité", "Un tiers", "La commune"), ("doit remettre", "peut prolonger", "est tenu de vérifier", "ne saurait céder", "conserve", "ne peut vendre", "signe"), ("le permis", "la copie du bail", "le plan corrigé", "le registre", "la demande complète", "les documents", "une copie"), ("dans le délai convenu.", "avant la fin de la saison.", "après un second avis.", "sauf accord contraire.", "au lieu de livraison.", "sans frais.")),
    (" ", ("Der Mieter", "Die Behörde", "Jeder Eigentümer", "Das Mitglied", "Der Antragsteller"), ("muss", "darf", "kann nicht", "soll"), ("die Unterlagen", "den Vertrag", "das Register", "die Kaution"), ("innerhalb von zehn Tagen einreichen.", "vor Ende der Saison kündigen.", "nach der Prüfung zurückgeben.", "ohne Zustimmung übertragen.", "nach Eingang des Antrags verlängern.")),
    (" ", ("El propietario", "La empresa", "Cada socio", "Il proprietario", "O inquilino"), ("debe conservar", "puede prorrogar", "no puede ceder", "deve consegnare", "deve devolver"), ("el registro", "el contrato", "la copia", "il documento", "o recibo"), ("en el plazo de diez días.", "antes de fin de año.", "entro trenta giorni.", "após o segundo aviso.", "sin acuerdo.")),
    (" ", ("Арендатор", "Владелец", "Каждый член", "Орган"), ("обязан вернуть", "может продлить", "не вправе передавать", "должен хранить"), ("документы", "договор", "реестр", "копию"), ("в течение десяти дней.", "до конца сезона.", "после проверки.")),
    ("", ("承租人", "登记机关", "合作社成员", "申请人", "监护人", "业主"), ("应当提交", "必须保存", "可以延长", "不得转让", "需要补充"), ("修订后的方案", "租赁合同", "年度报告", "相关材料", "保证金收据"), ("。", "，期限为三十天。", "，除非双方另有约定。")),
    ("", ("借主は", "所有者は", "会員は"), ("書類を", "契約書を", "登録簿を"), ("十日以内に", "季節が終わる前に", "審査の後に"), ("提出しなければならない。", "保管する。", "返還できる。")),
    (" ", ("임차인은", "소유자는", "회원은"), ("서류를", "계약서를", "등록부를"), ("열흘 안에", "시즌이 끝나기 전에"), ("제출해야 한다.", "보관한다.", "반환할 수 있다.")),
    ("", ("ผู้เช่า", "เจ้าของ", "สมาชิก"), ("ต้องยื่น", "อาจขยาย", "ไม่อาจโอน"), ("เอกสาร", "สัญญา", "ทะเบียน"), ("ภายในสิบวัน", "ก่อนสิ้นฤดูกาล", "หลังการตรวจสอบ")),
)


def statements(rng: random.Random, n: int) -> list[str]:
    """All of FOREIGN, and n statements put together from the parts, some of two sentences."""
    out = list(FOREIGN)
    for k in range(n):
        between, *parts = PARTS[k % len(PARTS)]
        said = between.join(rng.choice(p) for p in parts)
        if rng.random() < 0.25:
            said += " " + between.join(rng.choice(p) for p in parts)
        out.append(said)
    return out
