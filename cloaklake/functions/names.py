"""Recognisers of persons and places by rule, for where no model is plugged in: register() adds them.

A person is a title or a listed first name, followed by one to three words with a capital letter; a place is a listed name. They
find what is written in the usual way and listed; a model (see detect.with_model_hits) finds more.
"""

from __future__ import annotations

from pyspark.sql import Column

from . import patterns

FIRST_NAMES = [
    "Adam", "Alice", "Anna", "Antonio", "Carlos", "Carmen", "Charles", "Claire", "Daniel", "David", "Elena", "Emma", "Francesca", "François", "Giulia", "Hans", "James", "Jane", "Jean", "Jennifer",
    "John", "José", "Juan", "Julia", "Klaus", "Laura", "Lucia", "Marco", "Maria", "María", "Marie", "Mario", "Mary", "Max", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sophie", "Thomas",
]
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Signor", "Signora"]
PLACES = [
    "Amsterdam", "Athens", "Australia", "Austria", "Barcelona", "Belgium", "Berlin", "Boston", "Brazil", "Brussels", "Canada", "Chicago", "China", "Copenhagen", "Denmark", "Deutschland", "Dublin", "England",
    "España", "Europe", "Finland", "France", "Frankfurt", "Germany", "Greece", "Hamburg", "India", "Ireland", "Italia", "Italy", "Japan", "Köln", "Lisbon", "London", "Los Angeles", "Lyon", "Madrid", "Marseille",
    "Mexico", "Milan", "Milano", "Moscow", "München", "Munich", "Netherlands", "New York", "Norway", "Oslo", "Paris", "Poland", "Portugal", "Prague", "Roma", "Rome", "Russia", "San Francisco", "Seattle",
    "Seoul", "Sevilla", "Spain", "Stockholm", "Sweden", "Switzerland", "Sydney", "Tokyo", "Toronto", "Ukraine", "United Kingdom", "United States", "Valencia", "Vienna", "Warsaw", "Washington", "Wien", "Zürich",
]
WORD = r"\p{Lu}[\p{L}\'’-]+"


def person_hits(text: Column, score: float = 0.85) -> Column:
    rest = rf"(?: {WORD}){{1,3}}"
    found = patterns.find_all(text, rf"(?:(?:{'|'.join(TITLES)})\.? {WORD}(?: {WORD}){{0,2}}|(?:{'|'.join(FIRST_NAMES)}){rest})", "PERSON", score)
    return patterns.apart_only(text, found)


def location_hits(text: Column, score: float = 0.85) -> Column:
    return patterns.gazetteer_hits(text, PLACES, "LOCATION", score)


def register() -> None:
    """PERSON and LOCATION are found from now on wherever they are asked for."""
    patterns.register("PERSON", person_hits)
    patterns.register("LOCATION", location_hits)
