"""Cases that arrive while a job runs."""
