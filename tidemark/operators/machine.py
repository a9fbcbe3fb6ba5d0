"""The sessions of one workspace, row after row in order of time: the part of the state that windows can't express.

Which session a pause names, which one a start resumes and whether a timer fires all depend on what came before, so rows of a
workspace are taken in order. A task streams over sorted rows; it holds the sessions of the workspace (or of a piece of its
history) that it is at, and takes the same small effort for each row, however many sessions are open.

Rows come with what they need from elsewhere: whether the board is inactive at that time, why a start's workspace may not be
tracked (or ok), and the first start anywhere, from IDLE later on, that passes its gates.

* A session has a state from the first start on that passes the privacy and the board gate; its other events find no state.
* A start sweeps the open sessions, of all workspaces, that were last written IDLE or longer ago, paused ones too.
* A resuming start takes over the workspace's open session that was written last, with its issue, its pause and whether its
  user has been told; it cancels that session's timer and leaves its state as it is.
* A pause names the open session that was written last, and a resumption the one among those that are paused; it holds
  again only if its update went through, but writes the state anyway. A paused prompt changes nothing; a paused stop or end is
  written and stops the timer.
* On an inactive board a prompt or stop is written and stops the timer, but changes no status. An end ignores the board.
* A stop's timer closes the session IDLE later, unless a write or a resuming session comes before; at that very time it
  comes too late. On a board that is inactive then, it only writes.
* What a gate says is kept for the workspace: a blocked start, prompt, answer, stop or timer saves the reason, one that
  passes clears it, and what finds no state, a paused session or an end leaves it.
"""

from __future__ import annotations

import heapq
from operator import attrgetter

IDLE_SECONDS = 1800
IDLE_US = IDLE_SECONDS * 1_000_000
#: Fixed value: why nothing is tracked while the board is inactive.
INACTIVE = "project_inactive"

#: What the machine reads, and what it gives.
INPUT = ("at", "nth", "event_id", "hook", "session_id", "is_resume", "reason", "inactive", "went", "next_at", "next_id")
CARRIED = ("status", "paused", "wrote", "deadline", "sweep_at", "sweep_id", "notified", "issue_session", "depth")
OUTPUT = ("kind", "session_id", "at", "nth", "event_id", "hook", "decision", "runtime", "sets", "writes", "acts", "resumes", "first_prompt", *CARRIED)
OUTPUT_TYPES = (
    "kind string, session_id string, at bigint, nth int, event_id bigint, hook string, decision string, runtime string, sets string, writes boolean, acts boolean, resumes string, first_prompt boolean, "
    "status string, paused boolean, wrote bigint, deadline bigint, sweep_at bigint, sweep_id bigint, notified boolean, issue_session string, depth bigint"
)
STATUS = {"SessionStart": "registered", "UserPromptSubmit": "responding", "Stop": "waiting", "SessionEnd": "closed"}


_NOTHING = (None,) * len(CARRIED)


class _Session:
    __slots__ = CARRIED

    def __init__(self, *values):
        for name, value in zip(CARRIED, values, strict=True):
            setattr(self, name, value)

    #: All that is carried of a session, as a tuple.
    values = property(attrgetter(*CARRIED))


class Machine:
    def __init__(self, stop_gate: bool = True):
        """stop_gate: whether a stop honours the board gate; the tracker means it to, but doesn't."""
        self.stop_gate = stop_gate
        self.sessions: dict[str, _Session] = {}
        self.open: dict[str, None] = {}  # in order of their last writes
        self.paused: dict[str, None] = {}
        self.sweeps: list[tuple] = []
        self.out: list[tuple] = []

    def carry(self, session_id: str, *values) -> None:
        """A session as an earlier piece of the history left it; they come in order of their last writes."""
        own = self.sessions[session_id] = _Session(*values)
        self._file(session_id, own)

    def _file(self, name: str, own: _Session) -> None:
        self.open.pop(name, None)
        self.paused.pop(name, None)
        if own.status != "closed":
            self.open[name] = None
            if own.paused:
                self.paused[name] = None
            if own.sweep_at is not None:
                heapq.heappush(self.sweeps, (own.sweep_at, name))

    def _write(self, name: str, own: _Session, at: int, next_at: int | None, next_id: int | None) -> None:
        own.wrote, own.sweep_at, own.sweep_id = at, next_at, next_id
        self._file(name, own)

    def _emit(self, kind, name, at, nth, event_id, hook, own, decision=None, runtime=None, sets=None, writes=False, acts=False, resumes=None, first=False) -> None:
        self.out.append((kind, name, at, nth, event_id, hook, decision, runtime, sets, writes, acts, resumes, first, *(own.values if own else _NOTHING)))

    def settle(self, until: int | None) -> None:
        """Sessions that a start at or before `until` (any, if None) has swept."""
        while self.sweeps and (until is None or self.sweeps[0][0] <= until):
            at, name = heapq.heappop(self.sweeps)
            own = self.sessions[name]
            # neither written since, nor about to be closed by its timer, which comes first
            if own.status != "closed" and own.sweep_at == at and own.deadline is None:
                own.status = "closed"
                self._file(name, own)
                self._emit("sweep", name, at, -2, own.sweep_id, None, own, sets="closed", writes=True)

    def _newest(self, names: dict[str, None]) -> str | None:
        """Of the sessions written last the one with the greatest id."""
        best = None
        for name in reversed(names):
            if best is None or (self.sessions[name].wrote == self.sessions[best].wrote and name > best):
                best = name
            elif self.sessions[name].wrote != self.sessions[best].wrote:
                break
        return best

    def row(self, at, nth, event_id, hook, session_id, is_resume, reason, inactive, went, next_at, next_id) -> None:
        self.settle(at)
        if hook == "deadline":
            self._timer(at, nth, event_id, session_id, inactive, next_at, next_id)
        elif hook in ("pause", "resume"):
            self._control(at, nth, hook, went, next_at, next_id)
        elif hook == "SessionStart":
            self._start(at, nth, event_id, session_id, is_resume, reason, inactive, next_at, next_id)
        else:
            self._event(at, nth, event_id, hook, session_id, inactive, next_at, next_id)

    def _timer(self, at, nth, event_id, name, inactive, next_at, next_id) -> None:
        own = self.sessions.get(name)
        if own is None or own.deadline != at:
            return  # cancelled or replaced
        own.deadline = None
        if not inactive:
            own.status = "closed"
        self._write(name, own, at, next_at, next_id)
        self._emit("timer", name, at, nth, event_id, None, own, runtime=INACTIVE if inactive else "ok", sets=None if inactive else "closed", writes=True)

    def _control(self, at, nth, hook, went, next_at, next_id) -> None:
        name = self._newest(self.open if hook == "pause" else self.paused)
        if name is None:
            return
        own = self.sessions[name]
        if hook == "pause":
            own.paused, own.deadline = True, None
        elif went:
            own.paused = False
        self._write(name, own, at, next_at, next_id)
        self._emit("control", name, at, nth, None, hook, own, writes=True)

    def _start(self, at, nth, event_id, name, is_resume, reason, inactive, next_at, next_id) -> None:
        decision = INACTIVE if reason == "ok" and inactive else reason
        if decision != "ok" or name in self.sessions:
            blocked = decision if decision != "ok" else None
            self._emit("event", name, at, nth, event_id, "SessionStart", self.sessions.get(name), decision, blocked)
            return
        resumes = self._newest(self.open) if is_resume else None
        if resumes is None:
            own = _Session("registered", False, at, None, None, None, False, name, 0)
        else:
            old = self.sessions[resumes]
            old.deadline = None
            own = _Session("registered", old.paused, at, None, None, None, old.notified, old.issue_session, old.depth + 1)
        self.sessions[name] = own
        self._write(name, own, at, next_at, next_id)
        self._emit("event", name, at, nth, event_id, "SessionStart", own, "ok", "ok", "registered", True, True, resumes)

    def _event(self, at, nth, event_id, hook, name, inactive, next_at, next_id) -> None:
        own = self.sessions.get(name)
        if own is None:
            self._emit("event", name, at, nth, event_id, hook, None, "no_state")
            return
        gated = inactive and hook != "SessionEnd" and (hook != "Stop" or self.stop_gate)
        decision = "paused" if own.paused else INACTIVE if gated else "ok"
        acts, writes, first, sets = decision == "ok", hook != "PostToolUse", False, None
        runtime = None if own.paused or hook == "SessionEnd" or (hook == "Stop" and inactive and not gated) else decision
        if hook == "UserPromptSubmit":
            writes = not own.paused
            first = acts and not own.notified
            own.notified = own.notified or acts
        elif hook == "SessionEnd":
            acts = acts and own.status != "closed"
        if acts and writes:
            sets = own.status = STATUS[hook]
        if writes:
            own.deadline = at + IDLE_US if acts and hook == "Stop" else None
            self._write(name, own, at, next_at, next_id)
        self._emit("event", name, at, nth, event_id, hook, own, decision, runtime, sets, writes, acts, None, first)

    def taken(self) -> list[tuple]:
        """What has been given since it was last taken."""
        out, self.out = self.out, []
        return out

    def ends(self) -> None:
        """All sessions, for the next piece of the history."""
        for name, own in sorted(self.sessions.items(), key=lambda x: (x[1].wrote, x[0])):
            self._emit("end", name, None, None, None, None, own)


class Lasts(Machine):
    """Gives only the last row that writes of each session and the last that says whether anything is tracked."""

    def __init__(self, stop_gate: bool = True):
        super().__init__(stop_gate)
        self.lasts: dict[str | None, tuple] = {}

    def _emit(self, kind, name, at, nth, event_id, hook, own, decision=None, runtime=None, sets=None, writes=False, acts=False, resumes=None, first=False) -> None:
        if writes or runtime is not None:
            x = (kind, name, at, nth, event_id, hook, decision, runtime, sets, writes, acts, resumes, first, own.status if own else None, own.paused if own else None)
            if writes:
                self.lasts[name] = x
            if runtime is not None:
                self.lasts[None] = x

    def taken(self) -> list[tuple]:
        out, self.lasts = [(*x, *_NOTHING[2:]) for x in self.lasts.values()], {}
        return out
