"""Composed jobs: customer feature table, SQL reports, modelling and targeting."""
