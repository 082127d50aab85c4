"""Stateful processors: sessions that end by timers, and requests that are settled once.

State lies in Spark's store, one entry per session and one row per request, and is brought up to date by the rows of a micro-batch in the order of their time.  Timers
follow the watermark, so what ends a session or refuses a decision is event time and not the moment of the run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SESSION_STATE = "seen long, expires long, revoked long, told boolean, named boolean"
SESSION_OUT = "token string, event_id long, at_us long, kind string, state string"
REQUEST_STATE = "request_id long, status string, reason string, reply string"
WAITING = "request_id long, due_ms long, at_us long, decision_id long, verdict string, approver string, notes string"
APPROVAL_OUT = ("request_id long, decision_id long, at_us long, kind string, verdict string, ok boolean, error string, status string, "
                "approver string, reason string, output_redacted string")


def names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def plain(value):
    return None if pd.isna(value) else int(value)


def table(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names(schema), dtype=object)


class SessionFollower(StatefulProcessor):
    """Judges each access of a token and says when its session ends; see ``jobs.session_states``.

    State: the time last seen, both limits that are fixed, whether the end was told and whether an access was given its reason.
    One timer stands per session; it is set again if the session was used meanwhile.
    """

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION_STATE)

    def close(self) -> None:
        pass

    def limit(self, seen: int, expires: int | None, revoked: int | None) -> tuple[int, str]:
        """The first moment at which the session is over, and why.  A revocation holds from its own moment, the others after theirs."""
        ends = [(revoked, "revoked"), (None if expires is None else expires + 1, "expired"), (seen + self.idle + 1, "idle")]
        return min(((at, why) for at, why in ends if at is not None), key=lambda e: e[0])

    def watch(self, moment: int) -> None:
        self.handle.registerTimer(-(-moment // 1000))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        seen, expires, revoked = plain(r.seen), plain(r.expires), plain(r.revoked)
        self.session.update((seen, expires, revoked, False, False))
        self.watch(self.limit(seen, expires, revoked)[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        met = sorted((at, event_id) for part in rows for at, event_id in zip(part["at_us"].tolist(), part["event_id"].tolist()))
        if not self.session.exists():
            yield table([(key[0], event_id, at, "access", "unknown") for at, event_id in met], SESSION_OUT)
            return
        seen, expires, revoked, told, named = self.session.get()
        out = []
        for at, event_id in met:
            if revoked is not None and revoked <= at:
                fault = "revoked"
            elif expires is not None and at > expires:
                fault = "expired"
            else:
                fault = "idle" if at - seen > self.idle else None
            if named or (told and not fault):
                state = "revoked"
            elif fault:
                state, named = fault, True
                if not told:
                    end, why = self.limit(seen, expires, revoked)
                    out.append((key[0], None, end, "end", why))
                    told = True
            else:
                state, seen = "valid", at
            out.append((key[0], event_id, at, "access", state))
        self.session.update((seen, expires, revoked, told, named))
        yield table(out, SESSION_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, expires, revoked, told, named = self.session.get()
        end, why = self.limit(seen, expires, revoked)
        out = []
        if not told and -(-end // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], None, end, "end", why))
            self.session.update((seen, expires, revoked, True, named))
        elif not told:
            self.watch(end)
        yield table(out, SESSION_OUT)


class ApprovalMachine(StatefulProcessor):
    """Settles each held request once; see ``jobs.approval_events``.

    A request starts as the ledger has it.  From ``pending`` an approval leads to ``completed``, any other decision to ``rejected``; no other state is ever
    left, and a decision that comes then is told so.  A decision whose request is not there yet waits until the watermark passes it.

    A group is a block of neighbouring request ids (``jobs.approval_events`` bounds it), so that a call of Python and a visit to the store serve many
    requests.  State: one row per request, one per waiting decision; requests of a block have nothing else in common.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getListState("requests", REQUEST_STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def close(self) -> None:
        pass

    @staticmethod
    def held(state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []

    def wait(self, held: list[tuple]) -> None:
        self.waiting.put(held) if held else self.waiting.clear()

    @staticmethod
    def decided(request_id, decision: tuple, ok: bool, error: str | None, status: str | None, reason: str | None, reply: str | None) -> tuple:
        at, decision_id, verdict, approver, _ = decision
        return (request_id, decision_id, at, "decided", verdict, ok, error, status, approver if ok else None, reason, reply)

    def settle(self, request_id, request: tuple, decisions: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The state of the request after the decisions, and what they are told."""
        status, reason, reply = request
        out = []
        for decision in sorted(decisions, key=lambda d: d[:2]):
            verdict, notes = decision[2], decision[4]
            if status != "pending":
                out.append(self.decided(request_id, decision, False, f"Request is '{status}', not pending", status, reason, None))
                continue
            told = {"approve": "completed", "reject": "rejected"}.get(verdict, status)
            said = (notes or reason) if verdict == "reject" else reason
            out.append(self.decided(request_id, decision, True, None, told, said, reply if verdict == "approve" else None))
            status = "completed" if verdict == "approve" else "rejected"
        return (status, reason, reply), out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, decisions, out = defaultdict(list), defaultdict(list), []
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            for r in part.itertuples(index=False):
                if r.decision_id is None:
                    asked[r.request_id].append((r.at_us, r.status or "", r.reason, r.reply))
                else:
                    decisions[r.request_id].append((int(r.at_us), int(r.decision_id), r.verdict, r.approver, r.notes))
        known = {request_id: tuple(state) for request_id, *state in self.held(self.requests)}
        before = dict(known)
        held = self.held(self.waiting)
        opened = set()
        for request_id, requests in asked.items():
            if request_id in known:
                continue
            at, status, reason, reply = min(requests, key=lambda r: r[:2])
            known[request_id] = (status, reason, reply)
            opened.add(request_id)
            out.append((request_id, None, int(at), "opened", None, None, None, status, None, reason, None))
        kept = [h for h in held if h[0] not in opened]
        for request_id, _, *decision in held:
            if request_id in opened:
                decisions[request_id].append(tuple(decision))
        due = set()
        for request_id, given in decisions.items():
            if request_id in known:
                known[request_id], told = self.settle(request_id, known[request_id], given)
                out += told
            else:
                moment = -(-max(d[0] for d in given) // 1000)
                due.add(moment)
                kept += [(request_id, moment, *d) for d in given]
        if known != before:
            self.requests.put([(request_id, *state) for request_id, state in known.items()])
        if kept != held:
            self.wait(kept)
        for moment in due:
            self.handle.registerTimer(moment)
        yield table(out, APPROVAL_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        moment = expiredTimerInfo.getExpiryTimeInMs()
        held = self.held(self.waiting)
        due = {h[0] for h in held if h[1] <= moment}
        over = [h for h in held if h[0] in due and h[2] <= 1000 * moment]
        if over:
            gone = set(over)
            self.wait([h for h in held if h not in gone])
        yield table([self.decided(h[0], h[2:], False, "Request not found", None, None, None) for h in over], APPROVAL_OUT)
