"""The small labelled table that the personal-data tagger learns from: one text per row, spans as {kind:text}."""

# Invented examples; numbers are of reserved or made-up ranges.
EXAMPLES = """
Write to {email:ann.lee@mail.example.com} for the form.
Mail {email:bob_22@post.example.org}, or come by.
His address is {email:c.d+news@a-b.example.net}.
und {email:die.55@mail4.example.com} ist da
Reach me at {email:kim (at) example (dot) com} any time.
Contact: {email:jo.ray (at) mail.example.com}
Send it to {email:sam [at] example [dot] org} please.
the list {email:help [at] host.example.net} is open
Call {phone:+1 (017) 555-7713} before noon.
thlystti {phone:+1 (974) 555-3436} thatenon it
Phone: {phone:(415) 555-0182}
Call {phone:(017) 555-2210} or {phone:(018) 555-0199} now.
Tel. {phone:555-0123-4567} from nine to five
tel {phone:020 7946 0958} after six
Telephone {phone:0331 555 0147} for tickets.
my phone is {phone:212-555-0147}, call me
phone {phone:415.555.0199} at night
Fax {phone:(212) 555-0111} only.
mobile {phone:07700 900123} or office {phone:020 7946 0123}
The server {ip:192.0.2.17} went down.
log in from {ip:198.51.100.201} was refused
{ip:203.0.113.9} pinged twice
mente {ip:97.51.17.173} ueadoos
Card {card:4111 1111 1111 1111} was charged.
pay with {card:5500-0055-5555-5559} today
ciónci {card:4012888888881881} raie
card number {card:4222222222222220} expired
SSN {id:078-05-1120} on file.
social security number {id:219-09-9999}
ssn: {id:457-55-5462}, born in May
His social security {id:123-45-6789} leaked.
The meeting is on 2021-03-04 at 10:30.
It was 12/05/1999 when 3 of 40 left.
Version 3.2.1 of 2020 is out.
about 1234 words and 56 lines
Chapter 7, page 219, line 3.
Licensed under the Apache License, Version 2.0.
Licensed under CC BY-NC 4.0.
This work is licensed under the GNU General Public License, version 3.
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thhantou
key a1b2c3d4e5f6 was rotated in 2019
nntre token = "ede43f42c939b6405768150e0411590525cf889e" anhe
The price rose from 1,200 to 1,350 in 2018.
order 9807915762804491 arrived late
serial 7536784127813051 4845168114407321 èaique
part number 555-019 costs 20 euros
score 3-2 and 10-4, then 7-5
pages 100-120 and 300-355
In 1984 and 2001, 2010, 2015 he won 12 medals.
room 415, floor 2, building 7
the ratio is 0.125 or 12.5%
a @ sign, or @home, is no address
see @ann and @bob for 3 more
ISBN 978-3-16-148410-0 in print
bus 27, track 4-5, gate 12
item 12345 and item 67890 of 99999
Lines 10.20 and 30.40 differ by 5.
x1 y2 z3 w44 v555
1 2 3 4 5 6 7 8 9 10
in 1999 there were 555 birds
call 3 times in 10 minutes
tel me 2 more stories (at) home
the card has 16 corners, phone 2 friends
look [at] page 33, then (dot) the i
"""


def rows() -> list[str]:
    return [line for line in EXAMPLES.strip().splitlines() if line]
