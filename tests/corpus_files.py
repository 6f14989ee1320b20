"""A small file corpus: a five-message thread, copies, near copies, notices, an attachment, a PDF, an unknown file."""

from __future__ import annotations

import zlib
from email.message import EmailMessage
from pathlib import Path


def mail(path: Path, subject: str, body: str, n: int, *, sender="a@x.example", mid=None, reply=None, refs=None, attach=None) -> None:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = sender, "b@x.example", subject
    m["Date"] = f"Mon, {n:02d} Mar 2026 10:00:00 +0100"
    m["Message-ID"] = mid or f"<{path.stem}@x.example>"
    if reply:
        m["In-Reply-To"] = reply
    if refs:
        m["References"] = refs
    m.set_content(body)
    if attach:
        m.add_attachment(attach[1], filename=attach[0])
    path.write_bytes(bytes(m))


def pdf(text: str) -> bytes:
    stream = zlib.compress(f"BT /F1 12 Tf 72 720 Td ({text}) Tj ET".encode("latin-1"))
    return b"%%PDF-1.4\n1 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream\nendobj\n%EOF"


def build(folder: Path) -> Path:
    folder.mkdir(parents=True, exist_ok=True)
    ids = []
    for i in range(1, 6):
        mid = f"<m{i}@x.example>"
        body = f"Bericht {i} over de subsidie voor het museum en de plannen van dit jaar, deel {i}. " * 2
        mail(folder / f"thread-{i}.eml", ("Re: " if i > 1 else "") + "Subsidie museum", body, i, mid=mid, reply=ids[-1] if ids else None, refs=" ".join(ids) or None)
        ids.append(mid)
    same = "Het verslag van de vergadering over cultuur en de begroting staat in dit bericht, met alle besluiten."
    mail(folder / "dup-a.eml", "Verslag", same, 7)
    mail(folder / "dup-b.eml", "Doorsturen van stukken", same, 8, sender="c@x.example")
    near = " ".join(f"punt{i} van de lange nota over de begroting van cultuur" for i in range(20))
    mail(folder / "near-a.eml", "Nota een", near, 9)
    mail(folder / "near-b.eml", "Nota twee", near + " slot", 10)
    mail(folder / "notice.eml", "Automatisch antwoord: afwezig", "Ik ben er deze week niet, probeer het later nog een keer alstublieft.", 11, sender="no-reply@x.example")
    mail(folder / "invite.eml", "Uitnodiging: overleg", "BEGIN:VCALENDAR\nover de begroting van cultuur en het overleg daarover volgende week", 12)
    mail(folder / "with-attachment.eml", "Stukken", "In de bijlage staat de begroting voor de subsidie van cultuur in het jaar 2026.", 13, attach=("begroting.txt", "Begroting subsidie cultuur 2026: een overzicht van alle posten en bedragen."))
    (folder / "memo.pdf").write_bytes(pdf("Memo over de begroting en de subsidie voor cultuur in 2026, met toelichting"))
    (folder / "scan.pdf").write_bytes(b"%PDF-1.4\n%%EOF")
    (folder / "broken.pdf").write_bytes(b"nothing like it")
    (folder / "unknown.xyz").write_bytes(b"\x00\x01")
    return folder


def scripted_providers():
    from gleaner import providers as P

    return P.Providers(llm=P.ScriptedModel(lambda prompt: "SCORE: 50"), no_llm=False)
