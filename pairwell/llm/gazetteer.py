"""Default word lists for the search for personal data, all lower case; callers may pass their own.

Fixed values: common given names, family names, street words and places. The lists are samples, not registers: a
span needs more than one of them only where its other labelers disagree.
"""

from __future__ import annotations

from dataclasses import dataclass

GIVEN = tuple(
    "adam ahmed alejandro alexander alice amanda amy ana andrea andrew angela anna anne anthony antonio barbara ben benjamin brian carlos carmen "
    "carol catherine charles charlotte christian christine christopher claire daniel david deborah diego donald dorothy edward elena elizabeth emily emma "
    "eric fatima felix fernando francesca francisco franz frank gary george giovanni giulia grace hannah hans harry heather helen henry isabel jack "
    "jacob james jan jane jason javier jean jennifer jessica joan john jonathan jose joseph joshua juan julia julie karen karl kate katherine "
    "kevin klaus laura lea leon linda lisa louis lucas lucia luis luke manuel marco margaret maria marie mark martin mary matthew max "
    "michael michelle miguel mohammed nancy natalie nathan nicholas nicole olga oliver olivia pablo pamela patricia patrick paul pedro peter philip pierre "
    "rachel raj rebecca richard robert roberto ryan samantha samuel sandra sara sarah scott sean sofia sophie stefan stephen steven susan thomas tim "
    "ursula victoria wei william yuki zoe".split()
)
FAMILY = tuple(
    "adams ali allen anderson bailey baker bauer becker bell bernard bianchi brown campbell carter chen clark collins cook cooper cruz davies davis diaz "
    "dubois durand edwards evans fernandez ferrari fischer flores garcia gomez gonzalez green gutierrez hall harris hernandez hill hoffmann howard hughes "
    "ivanov jackson james jenkins johnson jones kelly khan kim king klein koch kumar lee lefebvre leroy lewis lopez martin martinez meyer miller mitchell "
    "moore morales moreau moreno morgan morris murphy müller nelson nguyen novak ortiz parker patel perez peterson petit phillips powell ramirez ramos "
    "reed reyes richardson richter rivera roberts robinson rodriguez rogers romero rossi ruiz russo sanchez sanders schmidt schneider schulz scott silva "
    "simon singh smith stewart suzuki tanaka taylor thomas thompson torres turner walker wagner wang ward watson weber white williams wilson wolf wood "
    "wright yang young zimmermann".split()
)
STREETS = tuple(
    "street st avenue ave road rd boulevard blvd lane ln drive dr court ct terrace square sq crescent parkway pkwy highway hwy rue impasse allée allee "
    "chemin quai calle avenida paseo plaza via viale piazza corso rua straße strasse str weg platz gasse ring ufer".split()
)
STREET_ENDS = tuple("straße strasse gasse platz allee straat laan gatan vej".split())
PLACES = tuple(
    "amsterdam athens atlanta austin barcelona beijing berlin boston brussels budapest cairo chicago cologne copenhagen dallas delhi denver detroit dubai "
    "dublin edinburgh florence frankfurt geneva hamburg helsinki houston istanbul kyoto lagos leipzig lima lisbon london lyon madrid manchester marseille "
    "melbourne miami milan montreal moscow mumbai munich münchen nairobi naples nice oslo paris philadelphia phoenix porto prague rome rotterdam seattle "
    "seoul sevilla shanghai singapore springfield stockholm stuttgart sydney tokyo toronto toulouse turin valencia vancouver vienna warsaw zurich zürich".split()
)


@dataclass(frozen=True)
class Gazetteer:
    """Lists that a labeler looks words up in; their sizes are the caller's, since they are part of the plan."""

    given: tuple[str, ...] = GIVEN
    family: tuple[str, ...] = FAMILY
    streets: tuple[str, ...] = STREETS
    street_ends: tuple[str, ...] = STREET_ENDS
    places: tuple[str, ...] = PLACES
