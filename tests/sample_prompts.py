"""Prompts of our own, one per kind of request, with known results."""

from __future__ import annotations

SAMPLE_PROMPTS: tuple[tuple[str, str, str, str, str], ...] = (
    ("card-refund", "Retail", "Refund to a card", "sovereign-local",
     "Please answer customer Noor Haddad, QID 27810293847. Order 771 was paid with 5500 0055 5555 5559 and comes back "
     "to account QA12ABCD00000000112233445566. Reach them at noor.haddad@mail.example or +974 3312 8890."),
    ("lease-check", "Leasing", "Lease check by an outside model", "external-cloud",
     "Could applicant and customer Omar Saleh (QID 28000000017) lease a van for 2,400 a month from "
     "IBAN QA77WXYZ00000000998877665544? Answer in one line."),
    ("clinic-note", "Clinic", "Note of a visit", "sovereign-local",
     "Shorten this note on patient Lina Farouk, MRN 550123, DOB 1985-11-30: diagnosed with influenza, rest for two days. "
     "Text the result to +974 5501 2030."),
    ("leaked-key", "Support", "Key in a ticket", "external-cloud",
     "Ticket of Mr. Adel Mansour (adel@desk.example): the job fails with key sk-00112233445566778899aabbccddeeff, why?"),
)
